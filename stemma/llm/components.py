"""Connected components of pairwise matches by alternating large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.tables import drop_settled, settle

MERGED = "merged"


def _star(edges: DataFrame, mins: DataFrame, *keep: str) -> DataFrame:
    """Each edge u-v of u joined with u's minimum m, as the edge (v, m)."""
    return edges.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), *keep)


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is linked to the smallest node among u and all its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # one row per node, combined before the shuffle; a node with a third of all edges is split by AQE on the side of its edges
    mins = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _star(both.where("v > u"), mins).where("u != v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """u and all its neighbours not larger than u are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = down.groupBy("u").agg(F.min("v").alias("m"))
    return _star(down, mins).unionAll(mins.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def finished(edges: DataFrame) -> DataFrame:
    """Adds `done` to edges (u, v) with u > v: the edge belongs to a star that no other edge touches.

    Such a star is a whole component. It is one if its centre is no larger end of any edge, and if each of its leaves
    has this one edge only and is no centre.
    """
    ends = edges.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("up"), F.lit(0).cast("long").alias("down"))
    roles = ends.unionAll(edges.groupBy(F.col("v").alias("node")).agg(F.lit(0).cast("long").alias("up"), F.count("*").alias("down")))
    mixed = roles.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").select("node")
    # centres that a mixed leaf touches, and mixed nodes themselves
    touched = edges.join(mixed, edges["u"] == mixed["node"], "left_semi").select(F.col("v").alias("node")).unionAll(mixed).distinct()
    return edges.join(touched.select(F.col("node").alias("v"), F.lit(False).alias("open")), "v", "left").select("u", "v", F.col("open").isNull().alias("done"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node linked directly or indirectly; nodes without another are left out.

    edges has the columns u and v. Nulls and self-links are dropped, repeats and direction don't matter. Every round is
    written to the shared folder, which cuts the lineage. Components that have become stars around their minimum leave
    the loop, and it ends when no edge is left; so late rounds only carry what is still joined by long chains. The driver
    sees one count per round.
    """
    current = settle(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    done = []
    for _ in range(most_rounds):
        stars = settle(small_star(large_star(current)))
        after = settle(finished(stars))
        drop_settled(stars)
        done.append(after.where("done").select(F.col("u").alias("node"), F.col("v").alias("component")))
        current = after.where("not done").select("u", "v")
        if current.isEmpty():
            found = done[0]
            for more in done[1:]:
                found = found.unionAll(more)
            return found
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def number_nodes(nodes: DataFrame) -> DataFrame:
    """(name, id): a 64-bit id for each distinct name, in the order of the names, from one range-partitioned sort.

    The ids are written once, as they depend on the partitions.
    """
    ordered = nodes.select("name").where("name is not null").distinct().repartitionByRange("name").sortWithinPartitions("name")
    return settle(ordered.select("name", F.monotonically_increasing_id().alias("id")))


def group_refs(links: DataFrame) -> DataFrame:
    """(source_ref, group_ref) for each ref of any row; group_ref is the smallest source ref of its group.

    Refs of one merged row belong together, and so do all merged rows with one canonical_ref that is not null. Other
    dispositions, null among them, join nothing. Null refs and rows without refs are ignored. The rounds work on 64-bit
    ids that sort as the refs do.
    """
    refs = links.select("canonical_ref", "disposition", F.array_compact(F.coalesce("source_refs", F.array().cast("array<string>"))).alias("refs")).where(
        F.size("refs") > 0
    )
    merged = refs.where(F.col("disposition") == MERGED).withColumn("least", F.array_min("refs"))
    of_row = merged.select(F.explode(F.array_except("refs", F.array("least"))).alias("u"), F.col("least").alias("v"))
    anchored = merged.where(F.col("canonical_ref").isNotNull()).select("canonical_ref", "least").distinct()
    # the smallest ref of each canonical_ref is found by a combined aggregate, so no group is gathered anywhere
    of_canonical = anchored.join(anchored.groupBy("canonical_ref").agg(F.min("least").alias("v")), "canonical_ref").select(F.col("least").alias("u"), "v")
    pairs = of_row.unionAll(of_canonical.where("u != v")).distinct()
    every = refs.select(F.explode("refs").alias("name"))
    ids = number_nodes(every)
    u, v = ids.select(F.col("name").alias("u"), F.col("id").alias("iu")), ids.select(F.col("name").alias("v"), F.col("id").alias("iv"))
    found = components(pairs.join(u, "u").join(v, "v").select(F.col("iu").alias("u"), F.col("iv").alias("v")))
    named = ids.join(found, F.col("id") == F.col("node"), "left").select(F.col("name").alias("source_ref"), F.coalesce("component", "id").alias("id"))
    return named.join(ids, "id").select("source_ref", F.col("name").alias("group_ref"))
