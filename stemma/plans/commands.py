"""What a user runs: merging files, cutting out a subtree, a quality report, exporting a tree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators import blocking, graph, identity, person, quality
from stemma.sources import gedcom, gedcom_writer, sqlite_tree
from stemma.tables import settle


@dataclass(frozen=True)
class Merge:
    """Lines with merged pointers, the decision for each pair, and the canonical pointer of each merged person."""

    lines: DataFrame
    decisions: list[dict]
    merged: dict[str, str]


def merge(spark: SparkSession, paths: list[str], threshold: float = identity.MERGE_THRESHOLD, resolver: Callable | None = None, limits: blocking.Limits = blocking.Limits()) -> Merge:
    """Unites several files. People of different files become one only on safe evidence or a resolver's word.

    Blocking, pairing and scoring are distributed; only scored pairs within the limits, and the people in them, come to the
    driver, where merging goes from the best pair on. All structures of merged people stay, under the surviving pointer.
    """
    if len(paths) < 2:
        raise ValueError("merging takes at least two files")
    ls = settle(gedcom.load(spark, paths))
    faults = gedcom.envelope_faults(gedcom.records(ls)).limit(20).collect()
    if faults:
        raise gedcom.GedcomError("; ".join(f"{f['source']}: {f['fault']}" for f in faults))
    recs, bs = gedcom.records(ls), gedcom.blocks(ls)
    people = settle(person.comparable(ls))
    keyed = person.blocking_keys(settle(gedcom.persons(bs, recs)), people)
    pairs = blocking.owner_pairs(keyed, "pointer", "source", limits.bucket)
    chosen = settle(blocking.capped_pairs(pairs, limits).select("l", "r"))
    scored = settle(identity.score_pairs(chosen, people, threshold).orderBy(F.desc("score"), "l", "r").limit(limits.candidates))
    found = [(r["l"], r["r"], r["score"]) for r in scored.select("l", "r", "score").collect()]
    wanted = scored.select(F.explode(F.array("l", "r")).alias("pointer")).distinct()
    known = {r["pointer"]: r.asDict(True) for r in people.join(wanted, "pointer", "left_semi").collect()}
    merged, decisions = identity.merge_people(found, known, resolver, limits)
    return Merge(_rewritten(ls, spark.createDataFrame(list(merged.items()), "p string, canonical string")), decisions, merged)


@dataclass(frozen=True)
class MergeAll:
    """Lines with merged pointers, and the decisions and canonical pointers as tables."""

    lines: DataFrame
    decisions: DataFrame
    merged: DataFrame


def merge_all(spark: SparkSession, paths: list[str], threshold: float = identity.MERGE_THRESHOLD, resolver: Callable | None = None, bucket: int = blocking.Limits.bucket) -> MergeAll:
    """As merge, without bounds on pairs and candidates, and with nothing of them on the driver.

    All pairs across files that share a key of at most `bucket` people are scored; groups of linked candidates are merged each on
    its own. Two people whom only commoner keys join are not compared.
    """
    if len(paths) < 2:
        raise ValueError("merging takes at least two files")
    ls = settle(gedcom.load(spark, paths))
    faults = gedcom.envelope_faults(gedcom.records(ls)).limit(20).collect()
    if faults:
        raise gedcom.GedcomError("; ".join(f"{f['source']}: {f['fault']}" for f in faults))
    recs, bs = gedcom.records(ls), gedcom.blocks(ls)
    people = settle(person.comparable(ls))
    keyed = person.blocking_keys(settle(gedcom.persons(bs, recs)), people)
    scored = identity.score_pairs(blocking.owner_pairs(keyed, "pointer", "source", bucket).select("l", "r"), people, threshold)
    merged, decisions = identity.merge_groups(scored, people, resolver)
    return MergeAll(_rewritten(ls, merged.select(F.col("pointer").alias("p"), "canonical")), decisions, merged)


def _rewritten(ls: DataFrame, names: DataFrame) -> DataFrame:
    """The lines with merged pointers (p, canonical) replaced; the level-1 structures of merged people follow those of the survivor, once."""
    if names.isEmpty():
        return ls
    value = F.trim(F.col("value"))
    key = F.when(F.col("xref") != "", F.col("xref")).when(F.col("tag").isin(*gedcom.POINTER_TAGS) & value.rlike(gedcom.POINTER), value)
    j = ls.withColumn("p", key).join(names, "p", "left")
    out = j.withColumn("xref", F.when((F.col("xref") != "") & F.col("canonical").isNotNull(), F.col("canonical")).otherwise(F.col("xref"))).withColumn(
        "value", F.when((F.col("xref") == "") & F.col("canonical").isNotNull(), F.col("canonical")).otherwise(F.col("value"))
    )
    out = settle(out.drop("p", "canonical"))
    heads = out.where("level = 0 and tag = 'INDI'").select("source", "rec", "ord", "xref")
    first = heads.groupBy("xref").agg(F.min(F.struct("ord", "rec", "source")).alias("f"))
    moved = heads.join(first, "xref").where("rec != f.rec or source != f.source").select("source", "rec", "f")
    both = out.join(moved, ["source", "rec"], "left")
    # structures of the absorbed record move behind the survivor's lines; its own first line goes
    kept = both.where("f is null or level > 0").select(
        F.coalesce("f.source", "source").alias("source"), F.coalesce("f.ord", "ord").alias("ord"), F.coalesce("f.rec", "rec").alias("rec"),
        F.when(F.col("f").isNotNull(), F.col("pos") + F.col("ord") * 10_000_000).otherwise(F.col("pos")).alias("pos"), "level", "xref", "tag", "value", "raw",
    )
    return _once(kept)


def _once(ls: DataFrame) -> DataFrame:
    """Lines without level-1 structures that their record already has, line for line."""
    from pyspark.sql import Window

    w = Window.partitionBy("source", "rec").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    b = ls.withColumn("block", F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(w))
    texts = b.where("block > 0").groupBy("source", "rec", "block").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", "level", "tag", "value").alias("t")))), lambda x: x["t"]), "\n"), 256).alias("h"))
    again = texts.withColumn("k", F.row_number().over(Window.partitionBy("source", "rec", "h").orderBy("block"))).where("k > 1").select("source", "rec", "block")
    return b.join(again, ["source", "rec", "block"], "left_anti").drop("block")


def find_root(people: DataFrame, root: str) -> str:
    """The pointer of a person by pointer or by a name that only one has."""
    hits = people.where((F.col("pointer") == root) | (F.lower("full_name") == root.strip().lower())).select("pointer").distinct().limit(3).collect()
    if len(hits) != 1:
        raise ValueError(f"{'no' if not hits else 'more than one'} person is {root}")
    return hits[0]["pointer"]


def subtree(ls: DataFrame, root: str, scope: str = "connected", most_generations: int | None = None) -> DataFrame:
    """The lines of the people in a scope of the root, their families, and all records these point to.

    connected takes whoever is linked by families, however far. Descendants come with the other parents of their children.
    """
    ls = settle(ls)
    recs, bs = settle(gedcom.records(ls)), settle(gedcom.blocks(ls))
    people, fam = settle(gedcom.persons(bs, recs)), settle(gedcom.family_edges(bs, recs))
    start = ls.sparkSession.createDataFrame([(find_root(people, root),)], "node string")
    pc = gedcom.parent_edges(fam)
    if scope == "connected":
        kept = graph.connected(fam.select(F.col("family").alias("src"), F.col("person").alias("dst")), start).select("node")
    elif scope == "ancestors":
        kept = graph.reach(pc.select(F.col("child").alias("src"), F.col("parent").alias("dst")), start, most_generations).select("node")
    elif scope == "descendants":
        down = graph.reach(pc.select(F.col("parent").alias("src"), F.col("child").alias("dst")), start, most_generations).select("node")
        theirs = pc.join(down.select(F.col("node").alias("child")), "child", "left_semi").join(pc.select("family", F.col("parent").alias("p2")).join(down.select(F.col("node").alias("p2")), "p2", "left_semi").select("family").distinct(), "family", "left_semi")
        kept = down.unionAll(theirs.select(F.col("parent").alias("node"))).distinct()
    else:
        raise ValueError(scope)
    kept = settle(kept)
    inside = fam.join(kept.select(F.col("node").alias("person")), "person", "left_semi")
    families = inside.groupBy("family").agg(F.countDistinct("person").alias("n")).where("n > 1").select(F.col("family").alias("node"))
    seeds = kept.unionAll(families).distinct()
    refs = gedcom.references(ls).join(recs.select("source", "rec", F.col("pointer").alias("src")), ["source", "rec"]).select("src", F.col("pointer").alias("dst"))
    aux = recs.where("tag in ('NOTE', 'SOUR', 'OBJE', 'REPO', 'SUBM')").select(F.col("pointer").alias("dst"))
    closure = graph.reach(refs.join(aux, "dst", "left_semi").select("src", "dst"), seeds).select("node").distinct()
    chosen = recs.join(closure.select(F.col("node").alias("pointer")), "pointer", "left_semi").select("source", "rec")
    envelope = recs.where("tag in ('HEAD', 'SUBM', 'TRLR')").select("source", "rec")
    out = ls.join(chosen.unionAll(envelope).distinct(), ["source", "rec"], "left_semi")
    # links to people and families left behind would dangle
    gone = recs.where("tag in ('INDI', 'FAM')").select(F.col("pointer").alias("v")).join(closure.select(F.col("node").alias("v")), "v", "left_anti").distinct()
    cut = out.where((F.col("level") == 1) & F.col("tag").isin("HUSB", "WIFE", "CHIL", "FAMC", "FAMS")).join(gone, F.trim("value") == F.col("v"), "left_semi").select("source", "rec", "pos")
    return out.join(cut, ["source", "rec", "pos"], "left_anti")


def quality_report(spark: SparkSession, path: str, as_of_year: int, root: str | None = None, resolver: Callable | None = None) -> str:
    """The Markdown report of one file; a file that can't be read gives a diagnostic report. A resolver may explain the first findings."""
    try:
        ls = settle(gedcom.strict(gedcom.lines(gedcom.read_texts(spark, [path]))))
    except Exception as e:
        if "Invalid GEDCOM line" not in str(e) and not isinstance(e, gedcom.GedcomError):
            raise
        return quality.parse_diagnostic(path.rsplit("/", 1)[-1], ValueError(next((t for t in str(e).splitlines() if "Invalid GEDCOM line" in t), str(e))))
    recs, bs = settle(gedcom.records(ls)), settle(gedcom.blocks(ls))
    if root:
        root = find_root(gedcom.persons(bs, recs), root)
    found = settle(quality.tree_findings(ls, as_of_year, root))
    if not root:
        none = spark.createDataFrame([], "person string, generation int")
        return quality.report(found, none, notes=quality.annotate(found, none, resolver) if resolver else None)
    parents = gedcom.parent_edges(gedcom.family_edges(bs, recs))
    near = settle(quality.generations(parents, root))
    return quality.report(found, near, relations=quality.parentage(parents, gedcom.person_edges(bs, recs), near), notes=quality.annotate(found, near, resolver) if resolver else None)


def export_tree(spark: SparkSession, tree: str, out: str, living: str = "exclude", version: str = "5.5.5", folder: str | None = None, root: str | None = None, scope: str = "connected", generations: int | None = None) -> DataFrame:
    """Writes a SQLite tree, or a scope of it around a root, as GEDCOM and gives (table_name, n_rows, lost): what of it isn't in the file.

    The tree is read from a copy that is checked not to have changed meanwhile, in a folder that all executors share. The file is
    checked before it counts; a faulty one is an error.
    """
    copy = sqlite_tree.snapshot(tree, folder)
    sqlite_tree.check_rows(copy)
    lines = settle(sqlite_tree.export_lines(spark, copy, living, root, scope, generations))
    gedcom_writer.write_gedcom(lines, out, version)
    text = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select(F.lit("out").alias("source"), F.lit(1).alias("ord"), F.decode("content", "UTF-8").alias("text"))
    bad = gedcom_writer.faults(gedcom.lines(text), version).limit(5).collect()
    if bad:
        raise gedcom.GedcomError(f"the export is faulty: {[(r['pos'], r['fault']) for r in bad]}")
    return sqlite_tree.export_losses(spark, copy, lines, living, root, scope, generations)


def accounting(result: Merge) -> dict[str, int]:
    """How many decisions there are of each kind."""
    counts: dict[str, int] = {}
    for d in result.decisions:
        counts[d["disposition"]] = counts.get(d["disposition"], 0) + 1
    return counts
