"""Traversal of person-family graphs by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.tables import settle


def reach(edges: DataFrame, roots: DataFrame, most_hops: int | None = None) -> DataFrame:
    """(node, depth): every node that the edges (src, dst) lead to from the roots, with the least number of hops.

    Each hop joins only the frontier, and drops what was visited. Lineage is cut in the shared folder each hop, so that
    deep graphs neither grow the plan nor depend on a lost executor. Nodes reached by several ways count once; cycles end
    by themselves.
    """
    edges = settle(edges.select("src", "dst"))  # read once a hop
    seen = settle(roots.select(F.col("node")).where("node is not null").distinct().withColumn("depth", F.lit(0)))
    frontier, parts, hop = seen, [seen], 0
    while most_hops is None or hop < most_hops:
        hop += 1
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).where("node is not null").distinct()
        step = settle(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(hop)))
        if step.isEmpty():
            break
        parts.append(step)
        seen, frontier = seen.unionAll(step), step
    return seen


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def connected(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth) of everything connected with the roots, whatever the direction."""
    return reach(both_ways(edges), roots)


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the largest label that the edges (src, dst) carry to each node of labels, from itself or from before it."""
    while True:
        came = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("new")), "src").groupBy(F.col("dst").alias("node")).agg(F.max("new").alias("new"))
        step = settle(labels.join(came, "node", "left").select("node", F.greatest("label", F.coalesce("new", "label")).alias("label"), (F.col("new") > F.col("label")).alias("moved")))
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles of edges (src, dst): nodes that reach each other share a component, its largest node.

    Nodes without a way in or out go first. Then the largest node before each is carried forward, and back from it among the nodes
    that have it: those it comes back to are a component. What is left goes round again; nothing comes to the driver but counts.
    """
    core = settle(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    alone = core.where("src = dst").select(F.col("src").alias("node"))
    core, found, n = settle(core.where("src != dst")), [alone.select("node", F.col("node").alias("component"))], -1
    while True:
        while (m := core.count()) != n and m:
            n = m
            core = settle(core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if not m:
            break
        nodes = core.select(F.col("src").alias("node")).distinct()
        forward = settle(_spread(core, nodes.select("node", F.col("node").alias("label"))))
        same = settle(core.join(forward.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(forward.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b").select("src", "dst", "a"))
        # back from the node that gave its name to the label
        back = reach(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), forward.where("node = label").select("node")).select("node")
        whole = settle(back.join(forward, "node").select("node", F.col("label").alias("component")))
        found.append(whole.join(whole.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"), "component", "left_semi").select("node", "component"))
        rest = core.join(whole.select(F.col("node").alias("src")), "src", "left_anti").join(whole.select(F.col("node").alias("dst")), "dst", "left_anti")
        core, n = settle(rest.select("src", "dst")), -1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return settle(out.groupBy("node").agg(F.max("component").alias("component")))


def cycle_members(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): members of cycles among what the roots reach."""
    near = reach(edges, roots).select("node")
    inside = edges.join(near.select(F.col("node").alias("src")), "src", "left_semi").join(near.select(F.col("node").alias("dst")), "dst", "left_semi")
    return strong_components(inside).select("node")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node linked directly or indirectly by the edges (src, dst), whatever their direction.

    Each round takes the smallest label around a node and then that label's own, which halves the ways that are left.
    """
    both = settle(both_ways(edges.where("src is not null and dst is not null")).distinct())
    labels = settle(both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("least"))
        own = labels.select(F.col("node").alias("least"), F.col("label").alias("own"))
        step = settle(least.join(own, "least").select("node", F.least("least", "own").alias("new"), "label"))
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("new != label").isEmpty():
            return labels.withColumnRenamed("label", "component")


def canonical_pointers(merged: DataFrame) -> DataFrame:
    """(pointer, canonical): follows a merge map (pointer, target) to its end, however long; loops end at their smallest member.

    A pointer has one target; of several the smallest counts. Pointers that end at themselves have no row. Each round doubles the
    steps; after as many steps as there are pointers, whoever has not come to an end is on a loop.
    """
    one = merged.where("pointer is not null and target is not null and pointer != target").groupBy("pointer").agg(F.min("target").alias("far"))
    # the least of what was passed, the pointer included
    current = settle(one.withColumn("least", F.col("pointer")))
    steps, n = 1, current.count()
    while True:
        onward = current.select(F.col("pointer").alias("far"), F.col("far").alias("further"), F.col("least").alias("passed"))
        step = settle(current.join(onward, "far", "left").select("pointer", F.coalesce("further", "far").alias("far"), F.least("least", F.coalesce("passed", "least")).alias("least"), F.col("further").isNotNull().alias("moved")))
        current = step.drop("moved")
        steps *= 2
        if steps > n or step.where("moved").isEmpty():
            break
    looped = current.select(F.col("pointer").alias("far"), F.col("least").alias("smallest"))
    return current.join(looped, "far", "left").select("pointer", F.coalesce("smallest", "far").alias("canonical")).where("pointer != canonical")
