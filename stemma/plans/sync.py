"""Bringing a master file up to date with snapshots: generations in a release folder, each with its master, manifest, state and report.

A release folder holds one folder per generation. A generation is built beside it and renamed into place, so readers see
all of it or nothing. State that grows (bindings of people, the registry of blocks, tombstones) is kept as tables.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.operators import blocking, identity, person, quality, relations, sync
from stemma.sources import gedcom, gedcom_writer, structure
from stemma.tables import settle

# Letters of pointers by record, who may deliver snapshots, names of sources, tags that say nothing of a source's content, records in the order in which they are united.
PREFIXES = {"FAM": "F", "INDI": "I", "NOTE": "N", "OBJE": "O", "REPO": "R", "SOUR": "S"}
VENDORS = ("ancestry", "geni", "myheritage", "other")
SOURCE_ID = re.compile(r"[a-z][a-z0-9_-]{1,63}")
SOURCE_ADMIN = ("CHAN", "RIN")
UNITED = ("REPO", "NOTE", "OBJE", "SOUR", "FAM")
NOT_UNITED = ("HEAD", "TRLR", "INDI", "SUBM")
REGISTRY = "person string, hash string, tag string, logical string, protected array<string>, observations array<string>, first_seen int, last_seen int"
SECTIONS = (
    "Added people", "Mapped people", "Unchanged people", "Added facts and structures", "Consolidated duplicate facts", "Citations attached", "Repeated citations united", "Source records united",
    "Conflicts kept", "Data removed", "Gone from the snapshots but kept", "People left unresolved",
)


class SyncError(ValueError):
    """An update that must not go on; the message begins with a code."""


@dataclass(frozen=True)
class Spec:
    """One snapshot of one source."""

    source_id: str
    vendor: str
    path: str
    sha256: str = ""
    exported_at: str = ""
    date_basis: str = "operator"

    @property
    def snapshot_id(self) -> str:
        return f"{self.source_id}-{self.sha256[:16]}"


@dataclass
class Manifest:
    tree_id: str
    generation: int = 0
    active_snapshots: dict[str, str] = field(default_factory=dict)
    snapshots: dict[str, dict] = field(default_factory=dict)
    next_ids: dict[str, int] = field(default_factory=lambda: {**dict.fromkeys(PREFIXES.values(), 1), "X": 1})
    master_sha256: str = ""


@dataclass(frozen=True)
class Outcome:
    """What an update did: its manifest, the folder it was published to (None for nothing to do or a dry run), and rows (section, entry)."""

    manifest: Manifest
    path: str | None
    events: DataFrame | None


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def file_facts(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, str]]:
    """(SHA-256, time of change) of each file, read by the executors."""
    rows = gedcom.read_files(spark, paths).select("ord", F.sha2("content", 256).alias("h"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t")).collect()
    return {paths[r["ord"] - 1]: (r["h"], r["t"]) for r in rows}


def specs(spark: SparkSession, inputs: list[Spec]) -> list[Spec]:
    """The inputs with content hash and date of export: as given, else from HEAD, else of the file. Sources must be new to the list and well named."""
    seen: set[str] = set()
    for s in inputs:
        if not SOURCE_ID.fullmatch(s.source_id) or s.vendor not in VENDORS:
            raise SyncError(f"SYNC_CONFIGURATION: source {s.source_id!r} or vendor {s.vendor!r} is not allowed")
        if s.source_id in seen:
            raise SyncError(f"SYNC_CONFIGURATION: source {s.source_id} was given more than once")
        seen.add(s.source_id)
    if not inputs:
        return []
    paths = [s.path for s in inputs]
    facts = file_facts(spark, paths)
    ls = gedcom.lines(gedcom.read_texts(spark, paths))
    heads = {r["source"]: r["exported_at"] for r in structure.header_dates(ls).collect()}
    out = []
    for i, s in enumerate(inputs, 1):
        digest, changed = facts[s.path]
        head = heads.get(gedcom.source_name(paths, i))
        at, basis = (s.exported_at, "operator") if s.exported_at else (head, "HEAD.DATE") if head else (changed, "file-mtime")
        out.append(Spec(s.source_id, s.vendor, s.path, digest, at, basis))
    return sorted(out, key=lambda s: (s.source_id, s.vendor, s.sha256))


def check_continuity(manifest: Manifest, given: list[Spec]) -> None:
    """A source keeps its vendor, and a snapshot id its content."""
    vendors = {s["source_id"]: s["vendor"] for s in manifest.snapshots.values()}
    for s in given:
        if vendors.get(s.source_id, s.vendor) != s.vendor:
            raise SyncError(f"SYNC_CONFIGURATION: source {s.source_id} belongs to {vendors[s.source_id]}")
        known = manifest.snapshots.get(s.snapshot_id)
        if known and known["sha256"] != s.sha256:
            raise SyncError(f"SYNC_CONFIGURATION: snapshot {s.snapshot_id} has another content")


def allocate(items: DataFrame, used: DataFrame, counters: dict[str, int]) -> tuple[DataFrame, dict[str, int]]:
    """((item, prefix, pointer), counters): new pointers @M_{prefix}{n}@ in the order of `key`, skipping those in use.

    items has item, prefix and key; used has pointer. Numbers go on from the counters. Items and used numbers are ranked
    together by a distributed sort: the k-th of both within its prefix gets number counter + k - 1. Used numbers are placed by
    how many free ones lie below them, so that none is given twice.
    """
    spark = items.sparkSession
    starts = spark.createDataFrame(list(counters.items()), "prefix string, start long")
    at = relations.ranked(items.select("item", "prefix", "key"), ["prefix", "key", "item"])
    first = at.groupBy("prefix").agg(F.min("rank").alias("least"))
    mine = at.join(first, "prefix").select("item", "prefix", (F.col("rank") - F.col("least")).alias("value"), F.lit(1).alias("kind"))
    taken = used.select(F.regexp_extract("pointer", r"^@M_([A-Z])(\d{1,15})@$", 1).alias("prefix"), F.regexp_extract("pointer", r"^@M_([A-Z])(\d{1,15})@$", 2).try_cast("long").alias("n")).where("n is not null").distinct()
    # a few counters
    taken = taken.join(F.broadcast(starts), "prefix").where("n >= start")
    ranked = relations.ranked(taken, ["prefix", "n"])
    base = ranked.groupBy("prefix").agg(F.min("rank").alias("least"))
    slots = ranked.join(base, "prefix").select(F.lit(None).cast(items.schema["item"].dataType).alias("item"), "prefix", (F.col("n") - F.col("start") - (F.col("rank") - F.col("least"))).alias("value"), F.lit(0).alias("kind"))
    both = relations.ranked(mine.unionByName(slots), ["prefix", "value", "kind", "item"])
    lowest = both.groupBy("prefix").agg(F.min("rank").alias("least"))
    given = settle(both.join(lowest, "prefix").join(F.broadcast(starts), "prefix").where("kind = 1").select("item", "prefix", (F.col("start") + F.col("rank") - F.col("least")).alias("n")))
    top = {r["prefix"]: r["n"] for r in given.groupBy("prefix").agg(F.max("n").alias("n")).collect()}
    return given.select("item", "prefix", F.concat(F.lit("@M_"), "prefix", F.col("n").cast("string"), F.lit("@")).alias("pointer")), {p: max(c, top.get(p, 0) + 1) for p, c in counters.items()}


def rewritten(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """Lines (..., tag, text) with pointers replaced by names (pointer, target), in pointer values only."""
    value = F.trim(F.col("text"))
    key = F.when(F.col("tag").isin(*gedcom.POINTER_TAGS) & value.rlike(gedcom.POINTER), value)
    j = blocks.withColumn("__p", key).join(names.select(F.col("pointer").alias("__p"), "target"), "__p", "left")
    return j.withColumn("text", F.coalesce("target", "text")).drop("__p", "target")


@dataclass
class People:
    """names: (pointer, target) of every person; bindings: (source_id, original, target); events: (section, entry)."""

    names: DataFrame
    bindings: DataFrame
    events: DataFrame
    counters: dict[str, int]


def match_people(ls: DataFrame, given: list[Spec], names: DataFrame, bindings: DataFrame, manifest: Manifest, resolver=None) -> People:  # noqa: ANN001
    """Which person of the master each person of the snapshots is; who is nobody becomes a new person with a pointer of the master's.

    Snapshots are taken one after the other, as people new from one are matched by the next; inside a snapshot all people are
    matched at once. Ways are those of sync.match_people; a way to two people leaves a new person, noted as unresolved. People
    of one snapshot that no way leads to and that share their fingerprint, an identifier or safe evidence become one new
    person. Pairs are scored if a binding, identifier, fingerprint or a blocking key that at most 128 people have joins them.
    A resolver is asked about the best scored pair without conflict of a person that no way leads to, at most 250 times.
    """
    spark = ls.sparkSession
    recs, bs = settle(gedcom.records(ls)), settle(gedcom.blocks(ls))
    people = settle(gedcom.persons(bs, recs).join(recs.where("tag = 'INDI'").select("source", "pointer", "ord"), ["source", "pointer"]))
    rich = settle(person.comparable(ls))
    blocks = structure.record_blocks(ls).where("record = 'INDI'")
    ids = settle(structure.identifiers(blocks))
    fields = [F.col(c) for c in ("full_name", "birth_date", "birth_place", "death_date", "death_place", "gender")]
    prints = settle(people.select("pointer", sync.fingerprint(*fields).alias("print")))
    content = blocks.groupBy("pointer").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "whole"))), lambda x: x["whole"]), "\n"), 256).alias("content"))
    known_ids = ids.groupBy("pointer").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    keys = settle(
        people.select("pointer", "ord", F.struct(*(F.lower(c) for c in fields)).alias("stated")).join(known_ids, "pointer", "left").join(content, "pointer", "left")
        .select("pointer", "ord", F.struct("stated", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), "content", "pointer").alias("key"))
    )
    keyed = settle(person.blocking_keys(people, rich))
    near = settle(blocking.owner_pairs(keyed, "pointer").select("l", "r"))
    originals = names.select("source", F.col("pointer").alias("original"), F.col("global").alias("pointer"))
    # (pointer, rep, target): every person met so far, and the person that stands for its target
    at = settle(people.where("ord = 1").select("pointer", F.col("pointer").alias("rep"), F.col("pointer").alias("target")))
    used = settle(recs.where("pointer != ''").select("pointer").distinct())
    counters, events, new_bindings, asked = dict(manifest.next_ids), [], [], 0
    for i, s in enumerate(given, 2):
        mine = people.where(F.col("ord") == i).select(F.col("pointer").alias("person"))
        reps = at.where("pointer = rep").select(F.col("rep").alias("master"), "target")
        was = bindings.where(F.col("source_id") == s.source_id).join(originals.join(people.where(F.col("ord") == i).select("pointer"), "pointer"), "original").select(F.col("pointer").alias("person"), "target").join(reps, "target").select("person", "master")
        my_ids, my_prints = ids.withColumnRenamed("pointer", "person").join(mine, "person", "left_semi"), prints.withColumnRenamed("pointer", "person").join(mine, "person", "left_semi")
        their = lambda t: t.withColumnRenamed("pointer", "master").join(reps.select("master"), "master", "left_semi")  # noqa: B023, E731
        both = near.unionAll(near.select(F.col("r").alias("l"), F.col("l").alias("r"))).select(F.col("l").alias("person"), F.col("r").alias("master"))
        both = both.join(mine, "person", "left_semi").join(reps.select("master"), "master", "left_semi")
        pairs = was.unionAll(my_ids.join(their(ids), "id").select("person", "master")).unionAll(my_prints.join(their(prints), "print").select("person", "master")).unionAll(both).distinct()
        scores = settle(identity.score_pairs(pairs.select(F.col("person").alias("l"), F.col("master").alias("r")), rich))
        found = settle(sync.match_people(mine, was, my_ids, their(ids), my_prints, their(prints), scores))
        hit = found.where("n = 1").select("person", "master", "how")
        if resolver is not None:
            best = scores.where((F.col("score") >= sync.MATCH_SCORE) & (F.size("conflicts") == 0)).join(found, F.col("l") == F.col("person"), "left_anti").groupBy(F.col("l").alias("person")).agg(F.max_by("r", F.struct("score", "r")).alias("master"), F.max("score").alias("score"))
            chosen = best.orderBy(F.desc("score"), "person").limit(max(0, blocking.Limits.adjudications - asked)).collect()
            wanted = [x for r in chosen for x in (r["person"], r["master"])]
            who = {r["pointer"]: r.asDict(True) for r in rich.where(F.col("pointer").isin(wanted)).collect()} if wanted else {}
            asked += len(chosen)
            said = [(r["person"], r["master"], "resolver") for r in chosen if sync.agreed(resolver(who[r["master"]], who[r["person"]]))]
            hit = hit.unionByName(spark.createDataFrame(said, hit.schema))
        hit = settle(hit.join(reps, "master").select("person", "master", "target", "how"))
        fresh = settle(mine.join(hit, "person", "left_anti"))
        lonely = fresh.join(found, "person", "left_anti")
        # people of this snapshot that are one: each points to the first of those it shares evidence with
        inside = near.join(lonely.select(F.col("person").alias("l")), "l", "left_semi").join(lonely.select(F.col("person").alias("r")), "r", "left_semi")
        safe = identity.score_pairs(inside, rich).where("safe").select("l", "r")
        alike = lambda t, on: t.join(lonely.withColumnRenamed("person", "pointer"), "pointer", "left_semi").withColumn("first", F.min(F.struct("pointer")).over(Window.partitionBy(on))).select(F.col("pointer").alias("r"), F.col("first.pointer").alias("l"))  # noqa: B023, E731
        parents = safe.unionByName(alike(prints, "print")).unionByName(alike(ids, "id")).where("l != r").select(F.greatest("l", "r").alias("x"), F.least("l", "r").alias("y"))
        one = _roots(parents.groupBy("x").agg(F.min("y").alias("y")))
        heads = fresh.join(one, F.col("person") == F.col("x"), "left").select("person", F.coalesce("root", "person").alias("rep"))
        heads = settle(heads)
        numbers, counters = allocate(
            heads.where("person = rep").join(keys.select(F.col("pointer").alias("person"), "key"), "person").select(F.col("person").alias("item"), F.lit("I").alias("prefix"), "key"), used, counters
        )
        numbers = settle(numbers)
        new = heads.join(numbers.select(F.col("item").alias("rep"), F.col("pointer").alias("target")), "rep").select(F.col("person").alias("pointer"), "rep", "target")
        step = settle(new.unionByName(hit.select(F.col("person").alias("pointer"), F.col("master").alias("rep"), "target")))
        at, used = at.unionByName(step), used.unionAll(numbers.select("pointer"))
        told = step.join(originals, "pointer").select("pointer", "original", "target")
        new_bindings.append(told.select(F.lit(s.source_id).alias("source_id"), "original", "target"))
        entry = F.concat(F.lit(f"{s.source_id}:"), "original", F.lit(" -> "), "target")
        before = bindings.where(F.col("source_id") == s.source_id).select("original", F.col("target").alias("old"))
        mapped = told.join(hit.select(F.col("person").alias("pointer"), "how"), "pointer").join(before, "original", "left")
        events += [
            told.join(heads.where("person = rep").select(F.col("person").alias("pointer")), "pointer", "left_semi").select(F.lit("Added people").alias("section"), entry.alias("entry")),
            mapped.select(F.when(F.col("old") == F.col("target"), "Unchanged people").otherwise("Mapped people").alias("section"), F.concat(entry, F.lit(" ("), "how", F.lit(")")).alias("entry")),
            told.join(found.where("n > 1").select(F.col("person").alias("pointer"), "n"), "pointer").select(F.lit("People left unresolved").alias("section"), F.concat(entry, F.lit(": leads to "), F.col("n").cast("string"), F.lit(" people")).alias("entry")),
        ]
    old = bindings.join(spark.createDataFrame([(s.source_id,) for s in given], "source_id string"), "source_id", "left_anti") if given else bindings
    return People(settle(at.select("pointer", "target")), settle(reduce(DataFrame.unionByName, new_bindings, old)), settle(reduce(DataFrame.unionByName, events, spark.createDataFrame([], "section string, entry string"))), counters)


def _roots(parents: DataFrame) -> DataFrame:
    """(x, root) of a forest (x, y), by doubling pointers."""
    at = settle(parents.select("x", F.col("y").alias("root")))
    while True:
        step = settle(at.join(at.select(F.col("x").alias("root"), F.col("root").alias("onward")), "root", "left").select("x", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        at = step.select("x", "root")
        if step.where("moved").isEmpty():
            return at


def _record_key(lines: DataFrame, tag: str) -> DataFrame:
    """(source, ord, pointer, key, own): the hash of each record's content without its pointer, and the hash that orders new records.

    Families count by their facts without notes, media and citations; sources without their administrative tags.
    """
    normal = structure.with_normal_values(lines.withColumn("text", F.coalesce("text", F.lit(""))), "tag", "text", "normal")
    w = Window.partitionBy("source", "rec").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = normal.withColumn("top", F.last(F.when(F.col("level") <= 1, F.col("tag")), ignorenulls=True).over(w)).withColumn("under", F.last(F.when(F.col("level") == 2, F.col("tag")).when(F.col("level") < 2, ""), ignorenulls=True).over(w))
    keep = ~((F.col("level") > 0) & F.col("top").isin(*SOURCE_ADMIN)) if tag == "SOUR" else ~((F.col("level") > 1) & F.col("under").isin(*structure.ATTACHMENT_TAGS)) if tag == "FAM" else F.lit(True)
    line = F.struct("pos", F.rtrim(F.concat_ws(" ", F.col("level").cast("string"), "tag", "normal")).alias("t"))
    text = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), "\n"), 256)
    return marked.groupBy("source", "ord", "rec").agg(F.max(F.when(F.col("level") == 0, F.col("xref"))).alias("pointer"), text(F.when(keep, line)).alias("key"), text(line).alias("own"))


def unite_records(ls: DataFrame, names: DataFrame, counters: dict[str, int], used: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """((pointer, target) of all records, events, counters): records of equal content become one, in the order of UNITED.

    Each kind is hashed with the pointers that were settled before it. The master's record stands for its content, else
    the first new one; new ones get pointers in the order of kind, content and pointer. Other records keep the master's
    pointer or get a new one.
    """
    spark = ls.sparkSession
    rel = settle(gedcom.continued(ls))
    recs = gedcom.records(ls).where(~F.col("tag").isin(*NOT_UNITED) & (F.col("pointer") != ""))
    at, events = names.select("pointer", "target"), []
    for tag in (*UNITED, None):
        mine = recs.where(F.col("tag") == tag if tag else ~F.col("tag").isin(*UNITED)).select("source", "rec")
        lines = rewritten(rel.join(mine, ["source", "rec"], "left_semi"), at)
        keyed = settle(_record_key(lines, tag or ""))
        group = ["key"] if tag else ["source", "rec"]
        first = keyed.groupBy(*group).agg(F.min(F.struct((F.col("ord") != 1).alias("new"), "own", "pointer")).alias("f")).select(*group, F.col("f.new").alias("new"), F.col("f.own").alias("own"), F.col("f.pointer").alias("rep"))
        prefix = PREFIXES.get(tag, "X")
        numbers, counters = allocate(first.where("new").select(F.col("rep").alias("item"), F.lit(prefix).alias("prefix"), F.struct("own", "rep").alias("key")), used, counters)
        numbers = settle(numbers)
        used = used.unionAll(numbers.select("pointer"))
        targets = first.join(numbers.select(F.col("item").alias("rep"), F.col("pointer").alias("made")), "rep", "left").select(*group, "rep", F.coalesce("made", "rep").alias("target"))
        placed = settle(keyed.join(targets, group).select("pointer", "rep", "target"))
        at = settle(at.unionByName(placed.select("pointer", "target")))
        if tag == "SOUR":
            events.append(placed.where("pointer != rep").select(F.lit("Source records united").alias("section"), F.concat("pointer", F.lit(" -> "), "target").alias("entry")))
    return at, reduce(DataFrame.unionByName, events, spark.createDataFrame([], "section string, entry string")), counters


def united_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((target, record, key, tag, logical, cited, at, lines), events): blocks of one target and key as one, with the attachments of all.

    blocks has target, ord and what structure.record_blocks gives. The first file's fact stays. Notes, media and citations are united by
    content, with as many copies of each as the one file has that has most; a citation that says no other than one of the
    same source, page, event and role but more is united with it. Blocks are small; a group holds what all files say of one fact.
    """
    single = blocks.withColumn("k", F.count("*").over(Window.partitionBy("target", "key")))
    alone = single.where("k = 1").select("target", "record", "key", "tag", "logical", "cited", F.struct(F.col("ord").cast("int").alias("ord"), F.col("rec").cast("long").alias("rec"), F.col("block").cast("long").alias("block")).alias("at"), "lines", F.lit(0).alias("attached"), F.lit(0).alias("repeated"))
    many = single.where("k > 1").select("target", "record", "key", "tag", "logical", "cited", "ord", "rec", "block", F.to_json("lines").alias("lines"))
    merged = many.groupBy("target", "key").applyInPandas(sync.unite_block, "target string, record string, key string, tag string, logical string, cited boolean, ord int, rec long, block long, lines string, attached int, repeated int")
    shape = "array<struct<pos: int, level: int, tag: string, text: string>>"
    merged = merged.select("target", "record", "key", "tag", "logical", "cited", F.struct("ord", "rec", "block").alias("at"), F.from_json("lines", shape).alias("lines"), "attached", "repeated")
    both = settle(alone.select(*(F.col(c) for c in merged.columns)).unionByName(merged))
    entry = F.concat_ws(":", "target", "tag", F.substring("key", 1, 12))
    events = (
        both.where("attached > 0").select(F.lit("Citations attached").alias("section"), entry.alias("entry"))
        .unionByName(both.where("repeated > 0").select(F.lit("Repeated citations united").alias("section"), entry.alias("entry")))
        .unionByName(merged.select(F.lit("Consolidated duplicate facts").alias("section"), entry.alias("entry")))
    )
    return both, events


def _master_lines(blocks: DataFrame, heads: DataFrame) -> DataFrame:
    """Lines (source, ord, rec, pos, level, xref, tag, value) of one file from records (target, record, value, order) and their blocks in order."""
    order = relations.ranked(heads, ["section", "order", "target"], "rec").select("target", "record", "value", F.col("rec").cast("long").alias("rec"))
    first = order.select(F.lit("master").alias("source"), F.lit(1).alias("ord"), "rec", F.lit(0).alias("pos"), F.lit(0).alias("level"), F.col("target").alias("xref"), F.col("record").alias("tag"), "value")
    w = Window.partitionBy("target").orderBy("at", "key")
    placed = blocks.withColumn("nth", F.row_number().over(w)).join(order.select("target", "rec"), "target")
    body = placed.select("rec", "nth", F.posexplode("lines").alias("i", "l")).select(
        F.lit("master").alias("source"), F.lit(1).alias("ord"), "rec", (F.col("nth") * 1_000_000 + F.col("i")).cast("int").alias("pos"), F.col("l.level").alias("level"), F.lit("").alias("xref"), F.col("l.tag").alias("tag"), F.col("l.text").alias("value")
    )
    return first.unionByName(body)


def report_lines(header: list[str], events: DataFrame) -> DataFrame:
    """(section, i, line): the update report: its head, twelve sections with their entries in order and once, and how to read it."""
    spark = events.sparkSession
    fixed = [(0, "", f"{n:04d}", line) for n, line in enumerate(["# Update report", "", *header])]
    for n, title in enumerate(SECTIONS, 1):
        fixed += [(n, "", "0", ""), (n, "", "1", f"## {title}"), (n, "", "2", "")]
    fixed += [(len(SECTIONS) + 1, "", f"{i}", line) for i, line in enumerate(["", "## How to read this", "", "Where a fact comes from is kept in the state of this generation, not as citations. Source records and citations stay with their facts."])]
    number = F.array_position(F.array(*(F.lit(s) for s in SECTIONS)), F.col("section")).cast("int")
    entries = events.select("section", "entry").distinct().select(number.alias("section"), F.col("entry").alias("order"), F.lit("").alias("i"), F.concat(F.lit("- `"), "entry", F.lit("`")).alias("line"))
    none = spark.createDataFrame([(n,) for n in range(1, len(SECTIONS) + 1)], "section int").join(entries.select("section").distinct(), "section", "left_anti").select("section", F.lit("").alias("order"), F.lit("3").alias("i"), F.lit("None.").alias("line"))
    return spark.createDataFrame(fixed, "section int, order string, i string, line string").unionByName(entries).unionByName(none)


def latest(spark: SparkSession, root: str) -> tuple[Manifest, str]:
    """The manifest of the newest generation in a release folder, and its path; its master must be the one it names."""
    fs, p = _fs(spark, root)
    found = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("generation-"))
    if not found:
        raise SyncError(f"MANIFEST_MISSING: {root} has no generation")
    path = f"{root}/{found[-1]}"
    m = Manifest(**json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0]))
    if master_digest(spark, f"{path}/master") != m.master_sha256:
        raise SyncError("MANIFEST_MASTER_MISMATCH: the master is not the one of its manifest; rebase an edited one")
    return m, path


def master_digest(spark: SparkSession, path: str) -> str:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.sha2("content", 256)).first()[0]


def _publish(spark: SparkSession, root: str, manifest: Manifest, lines: DataFrame, tables: dict[str, DataFrame], report: DataFrame, version: str, quality_root: str | None = None) -> str:
    """Builds a generation beside the others and renames it into place; what fails is deleted."""
    fs, _ = _fs(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    draft, final = f"{root}/.draft-{uuid.uuid4().hex}", f"{root}/generation-{manifest.generation:06d}"
    try:
        gedcom_writer.write_gedcom(lines, f"{draft}/master", version)
        made = gedcom.lines(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{draft}/master").select(F.lit("master").alias("source"), F.lit(1).alias("ord"), F.decode("content", "UTF-8").alias("text")))
        bad = gedcom_writer.faults(made, version).limit(5).collect()
        if bad:
            raise SyncError(f"OUTPUT_INVALID: {[(r['pos'], r['fault']) for r in bad]}")
        for name, df in tables.items():
            df.write.parquet(f"{draft}/{name}")
        report.orderBy("section", "order", "i").select("line").coalesce(1).write.text(f"{draft}/update-report")
        if quality_root:
            found = settle(quality.tree_findings(gedcom.strict(made), 9999, quality_root))
            _write_text(spark, f"{draft}/quality-report.md", quality.report(found, spark.createDataFrame([], "person string, generation int")))
        manifest.master_sha256 = master_digest(spark, f"{draft}/master")
        _write_text(spark, f"{draft}/manifest.json", json.dumps(asdict(manifest), indent=2, sort_keys=True, ensure_ascii=False) + "\n")
        if fs.exists(path(final)) or not fs.rename(path(draft), path(final)):
            raise SyncError(f"PUBLISH_CONFLICT: {final} is there already")
    except BaseException:
        fs.delete(path(draft), True)
        raise
    return final


def _apply(spark: SparkSession, paths: list[str], given: list[Spec], manifest: Manifest, bindings: DataFrame, registry: DataFrame, tombstones: DataFrame, resolver, initialize: bool) -> tuple[DataFrame, dict[str, DataFrame], DataFrame, Manifest]:  # noqa: ANN001
    raw = settle(gedcom.strict(gedcom.lines(gedcom.read_texts(spark, paths))))
    faults = gedcom.envelope_faults(gedcom.records(raw)).limit(20).collect()
    if faults:
        raise gedcom.GedcomError("; ".join(f"{f['source']}: {f['fault']}" for f in faults))
    names = settle(gedcom.global_pointers(raw))
    ls = settle(gedcom.renamed(raw, names))
    generation = manifest.generation + 1
    who = match_people(ls, given, names, bindings, manifest, resolver)
    used = gedcom.records(ls).where("pointer != ''").select("pointer").unionAll(who.names.select(F.col("target").alias("pointer"))).distinct()
    targets, united, counters = unite_records(ls, who.names, who.counters, used)
    targets = settle(targets)
    # blocks are hashed with the final pointers
    rel = rewritten(gedcom.continued(ls), targets).withColumn("value", F.col("text"))
    blocks = structure.record_blocks(rel.select("source", "ord", "rec", "pos", "level", "xref", "tag", "value"))
    blocks = settle(blocks.join(targets, "pointer", "left").withColumn("target", F.coalesce("target", "pointer")).where("target != '' and record != 'SUBM' or ord = 1").where("record not in ('HEAD', 'TRLR')"))
    snapshot = spark.createDataFrame([(i, s.source_id, s.snapshot_id) for i, s in enumerate(given, 2)], "ord int, source_id string, snapshot_id string")
    people = blocks.where("record = 'INDI'")
    seen = people.join(F.broadcast(snapshot), "ord", "left").select(F.col("target").alias("person"), F.col("key").alias("hash"), "tag", "logical", "source_id", F.col("snapshot_id").alias("snapshot"), F.col("cited"))
    active = manifest.active_snapshots | {s.source_id: s.snapshot_id for s in given}
    state = sync.register(registry, seen, tombstones, spark.createDataFrame([(a,) for a in sorted(active.values())], "snapshot string"), generation, initialize)
    dead = state.where("fate = 'tombstone'").select(F.col("person").alias("target"), F.col("hash").alias("key"))
    gone = state.where("fate = 'removed'").select(F.col("person").alias("target"), F.col("hash").alias("key"))
    # a block with a tombstone doesn't come back from a snapshot; records of other kinds come once
    alive = people.join(dead, ["target", "key"], "left_anti").unionByName(people.where("ord = 1").join(dead, ["target", "key"], "left_semi"))
    first = blocks.where("record != 'INDI'").groupBy("target").agg(F.min(F.struct("ord", "rec", "source")).alias("f"))
    others = blocks.where("record != 'INDI'").join(first, "target").where("record = 'FAM' or (ord = f.ord and rec = f.rec and source = f.source)").drop("f")
    whole, cites = united_blocks(alive.select(*others.columns).unionByName(others))
    kept = settle(whole.join(gone, ["target", "key"], "left_anti"))
    entry = F.concat_ws(":", "person", "tag", F.substring("hash", 1, 12))
    fates = {"removed": "Data removed", "kept": "Gone from the snapshots but kept", "tombstone": "Conflicts kept", "added": "Added facts and structures"}
    fate = F.col("fate")
    section = reduce(lambda c, kv: F.when(fate == kv[0], kv[1]).otherwise(c), fates.items(), F.lit(None).cast("string"))
    events = settle(reduce(DataFrame.unionByName, [who.events, united, cites, state.select(section.alias("section"), entry.alias("entry")).where("section is not null")]))
    heads = gedcom.records(ls).where("tag not in ('HEAD', 'TRLR')").where("pointer != '' or ord = 1").join(targets, "pointer", "left").withColumn("target", F.coalesce("target", "pointer")).where("tag != 'SUBM' or ord = 1")
    values = gedcom.continued(ls).where("level = 0").select("source", "rec", F.col("text").alias("value"))
    # persons by pointer, other records as they came
    record = heads.join(values, ["source", "rec"]).groupBy("target").agg(F.min_by(F.struct(F.col("tag").alias("record"), "value"), F.struct("ord", "rec")).alias("r"), F.min(F.struct("ord", "rec")).alias("order")).select("target", "r.*", "order")
    record = record.withColumn("section", F.when(F.col("record") == "SUBM", 1).when(F.col("record") == "INDI", 2).when(F.col("record") == "FAM", 3).otherwise(4))
    master = _master_lines(kept, record)
    next_state = state.where("fate != 'removed' and fate != 'tombstone'").select("person", "hash", "tag", "logical", "protected", "observations", "first_seen", "last_seen")
    history = manifest.snapshots | {s.snapshot_id: {"snapshot_id": s.snapshot_id, "source_id": s.source_id, "vendor": s.vendor, "path": s.path, "sha256": s.sha256, "exported_at": s.exported_at, "date_basis": s.date_basis} for s in given if s.snapshot_id not in manifest.snapshots}
    after = Manifest(manifest.tree_id, generation, active, history, counters)
    return master, {"bindings": who.bindings, "registry": next_state, "tombstones": tombstones}, events, after


_BINDINGS, _TOMBSTONES = "source_id string, original string, target string", "person string, hash string, logical string, generation int, reason string"


def _header(manifest: Manifest, given: list[Spec], mode: str) -> list[str]:
    out = [f"- Tree: `{manifest.tree_id}`", f"- Generation: {manifest.generation}", f"- Mode: {mode}", "", "## Snapshots", ""]
    return out + [f"- `{s.source_id}` ({s.vendor}): `{s.sha256}`; exported {s.exported_at} ({s.date_basis})" for s in given]


def initialize(spark: SparkSession, root: str, tree_id: str, master: str, version: str = "5.5.5") -> Outcome:
    """The first generation: the master alone, all its blocks protected as the baseline."""
    fs, p = _fs(spark, root)
    if fs.exists(p) and any(s.getPath().getName().startswith("generation-") for s in fs.listStatus(p)):
        raise SyncError(f"PUBLISH_CONFLICT: {root} has generations")
    fs.mkdirs(p)
    none = lambda schema: spark.createDataFrame([], schema)
    lines, tables, events, after = _apply(spark, [master], [], Manifest(tree_id), none(_BINDINGS), none(REGISTRY), none(_TOMBSTONES), None, True)
    return Outcome(after, _publish(spark, root, after, lines, tables, report_lines(_header(after, [], "first generation"), events), version), events)


def update(spark: SparkSession, root: str, inputs: list[Spec], resolver=None, dry_run: bool = False, version: str = "5.5.5", quality_root: str | None = None) -> Outcome:  # noqa: ANN001
    """The next generation from the newest one and a snapshot of each given source; nothing to do if all are in force already."""
    manifest, path = latest(spark, root)
    given = specs(spark, inputs)
    check_continuity(manifest, given)
    if all(manifest.active_snapshots.get(s.source_id) == s.snapshot_id for s in given):
        return Outcome(manifest, None, None)
    read = lambda n: settle(spark.read.parquet(f"{path}/{n}"))
    master = [s.getPath().toString() for s in _fs(spark, path)[0].listStatus(_fs(spark, f"{path}/master")[1]) if s.getPath().getName().startswith("part-")]
    lines, tables, events, after = _apply(spark, [*master, *(s.path for s in given)], given, manifest, read("bindings"), read("registry"), read("tombstones"), resolver, False)
    if dry_run:
        return Outcome(after, None, events)
    return Outcome(after, _publish(spark, root, after, lines, tables, report_lines(_header(after, given, "release"), events), version, quality_root), events)


def rebase(spark: SparkSession, root: str, edited: str, accept_deletions: bool = False, reason: str = "", version: str = "5.5.5") -> Outcome:
    """A generation from a master that was edited by hand: what was added is protected, what was deleted becomes a tombstone, with consent.

    Tombstones of blocks that the edited master has again are dropped.
    """
    manifest, path = latest(spark, root)
    load = lambda t: structure.record_blocks(gedcom.strict(gedcom.lines(t))).where("record = 'INDI'")
    old_text = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/master").select(F.lit("master").alias("source"), F.lit(1).alias("ord"), F.decode("content", "UTF-8").alias("text"))
    key = ["person", "hash"]
    index = lambda b: settle(b.groupBy(F.col("pointer").alias("person"), F.col("key").alias("hash")).agg(F.min("tag").alias("tag"), F.min("logical").alias("logical")))
    before, now = index(load(old_text)), index(load(gedcom.read_texts(spark, [edited])))
    added, deleted = settle(now.join(before.select(*key), key, "left_anti")), settle(before.join(now.select(*key), key, "left_anti"))
    n = deleted.count()
    if n and not accept_deletions:
        raise SyncError(f"SYNC_UNSAFE_REMOVAL: the edited master lacks {n} blocks; deletions need consent")
    generation = manifest.generation + 1
    registry, tombstones = spark.read.parquet(f"{path}/registry"), spark.read.parquet(f"{path}/tombstones")
    manual = added.select(*key, "tag", "logical", F.array(F.lit("manual")).alias("protected"), F.array().cast("array<string>").alias("observations"), F.lit(generation).alias("first_seen"), F.lit(generation).alias("last_seen"))
    kept = registry.join(now.select(*key), key, "left_semi").join(added.select(*key), key, "left_anti")
    dead = tombstones.join(added.select(*key), key, "left_anti").unionByName(deleted.select(*key, "logical", F.lit(generation).alias("generation"), F.lit(reason).alias("reason")))
    after = Manifest(manifest.tree_id, generation, manifest.active_snapshots, manifest.snapshots, manifest.next_ids)
    ls = gedcom.strict(gedcom.lines(gedcom.read_texts(spark, [edited])))
    entry = F.concat_ws(":", "person", "tag", F.substring("hash", 1, 12))
    events = settle(added.select(F.lit("Added facts and structures").alias("section"), entry.alias("entry")).unionByName(deleted.select(F.lit("Data removed").alias("section"), entry.alias("entry"))))
    tables = {"bindings": spark.read.parquet(f"{path}/bindings"), "registry": settle(kept.unionByName(manual)), "tombstones": settle(dead)}
    return Outcome(after, _publish(spark, root, after, ls, tables, report_lines(_header(after, [], f"rebase: {reason}"), events), version), events)

