"""GEDCOM files as DataFrames: lines, records, facts, names, persons and family edges.

Everything is declared over one table of lines. Records, blocks and continued texts are numbered by running sums inside
a file and put together by grouped aggregates, so many files are read in parallel and only needed tags are carried on.
A file is one row while it is cut into lines; the format bounds it at 512 MiB.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.functions.dates import with_normalized_dates

# Fixed values of the format: a line, a pointer, and the tags whose value may be a pointer.
LINE = r"^(0|[1-9][0-9]?)(?:\s+(@[^@\s]+@))?\s+([A-Za-z0-9_]+)(?:\s(.*))?$"
POINTER = r"^@[^@\s]+@$"
POINTER_TAGS = ("ALIA", "ASSO", "CHIL", "FAMC", "FAMS", "HUSB", "WIFE", "OBJE", "NOTE", "REPO", "SOUR", "SUBM", "SNOTE", "WITN")
NAME_PARTS = ("GIVN", "SURN", "NICK", "NPFX", "NSFX", "TYPE")
EVENT_TAGS = (
    "ADOP", "BAPM", "BARM", "BASM", "BIRT", "BLES", "BURI", "CAST", "CENS", "CHR", "CHRA", "CONF", "CREM", "DEAT", "DSCR", "EDUC", "EMIG", "EVEN", "FCOM", "GRAD", "IMMI", "NATI",
    "NATU", "OCCU", "ORDN", "PROB", "PROP", "RELI", "RESI", "RETI", "TITL",
)
FAMILY_EVENT_TAGS = ("ANUL", "DIV", "DIVF", "ENGA", "MARB", "MARC", "MARL", "MARR", "MARS")
MAX_BYTES = 512 * 1024 * 1024


class GedcomError(ValueError):
    """A text that is not GEDCOM, with the place of the fault."""


def decode(data: bytes) -> str:
    """UTF-8, or UTF-16 with a byte order mark; NUL and UTF-32 are refused."""
    if data[:4] in (b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff"):
        raise GedcomError("UTF-32 is not read")
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = data.decode("utf-16")
    else:
        text = data.decode("utf-8-sig")
    if "\x00" in text:
        raise GedcomError("NUL in text")
    return text


@F.pandas_udf(T.StringType())
def _decoded(contents: pd.Series) -> pd.Series:
    return contents.map(decode)


@dataclass(frozen=True)
class Budget:
    """What a file may hold; more is an error, never left out in silence."""

    file_bytes: int = MAX_BYTES
    records: int = 5_000_000
    record_bytes: int = 16 * 1024 * 1024
    line_bytes: int = 1024 * 1024


def source_name(paths: list[str], i: int) -> str:
    """The name of the i-th file (from 1): its base name, with its number before it where several files share one."""
    base = [p.rstrip("/").rsplit("/", 1)[-1] for p in paths]
    return base[i - 1] if base.count(base[i - 1]) == 1 else f"{i}/{base[i - 1]}"


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, ord, path, length, modificationTime, content): one row per file, in the order of `paths`; a path that is missing or given twice is an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    full = [hadoop(p).getFileSystem(conf).makeQualified(hadoop(p)).toString() for p in paths]
    if len(set(full)) < len(full):
        raise GedcomError("a file is given twice")
    order = spark.createDataFrame([(p, source_name(paths, i), i) for i, p in enumerate(full, 1)], "__path string, source string, ord int")
    files = spark.read.format("binaryFile").load(full).withColumn("__path", F.regexp_replace("path", "^([a-z]+):/+", "$1:/"))
    # one row per file
    order = order.withColumn("__path", F.regexp_replace("__path", "^([a-z]+):/+", "$1:/"))
    return files.join(F.broadcast(order), "__path").select("source", "ord", "path", "length", "modificationTime", "content")


def read_texts(spark: SparkSession, paths: list[str], budget: Budget = Budget()) -> DataFrame:
    """(source, ord, text): one row per file, in the order of `paths`. Files beyond the budget are an error."""
    files = read_files(spark, paths)
    big = files.where(F.col("length") > budget.file_bytes).select("source", "length").limit(5).collect()
    if big:
        raise GedcomError("; ".join(f"{r['source']} has {r['length']} bytes, {budget.file_bytes} are allowed" for r in big))
    return files.select("source", "ord", _decoded("content").alias("text"))


def over_budget(ls: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(source, rec, what, value): files with too many records, and records or lines with too many bytes."""
    w = F.octet_length("raw")
    recs = ls.groupBy("source", "rec").agg(F.sum(w + 1).alias("bytes"), F.max(w).alias("longest"))
    wide = recs.select("source", "rec", F.explode(F.array_compact(F.array(
        F.when(F.col("bytes") > budget.record_bytes, F.struct(F.lit("record bytes").alias("what"), F.col("bytes").cast("long").alias("value"))),
        F.when(F.col("longest") > budget.line_bytes, F.struct(F.lit("line bytes").alias("what"), F.col("longest").cast("long").alias("value"))),
    ))).alias("o")).select("source", "rec", "o.*")
    many = recs.groupBy("source").agg(F.count("*").alias("value")).where(F.col("value") > budget.records).select("source", F.lit(None).cast("long").alias("rec"), F.lit("records").alias("what"), "value")
    return wide.unionByName(many)


def lines(texts: DataFrame) -> DataFrame:
    """(source, ord, pos, rec, level, xref, tag, value, raw, bad): one row per line that is not blank.

    pos counts from 1 with blank lines. rec numbers the records of a file. A line that is not GEDCOM is kept with bad = true
    and null parts; `strict` turns it into an error.
    """
    cut = texts.select("source", "ord", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("p", "raw")).where(F.trim("raw") != "")
    parsed = _parts(cut.withColumn("pos", F.col("p") + 1))
    w = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return parsed.withColumn("rec", F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).over(w))


def parsed(cut: DataFrame) -> DataFrame:
    """As lines, from a table of lines (source, ord, pos, raw) of any number, whose records are numbered over all files without gathering one in a task."""
    from stemma.operators.relations import running

    return running(_parts(cut), ["source", "pos"], F.when(F.col("level") == 0, 1).otherwise(0), "rec")


def _parts(cut: DataFrame) -> DataFrame:
    raw = F.regexp_replace("raw", "^\ufeff", "")
    part = lambda i: F.regexp_extract(raw, LINE, i)
    bad = ~raw.rlike(LINE)
    return cut.select(
        "source", "ord", "pos", F.when(~bad, part(1).cast("int")).alias("level"), F.when(~bad, part(2)).alias("xref"), F.when(~bad, F.upper(part(3))).alias("tag"),
        F.when(~bad, part(4)).alias("value"), raw.alias("raw"), bad.alias("bad"),
    )


def strict(ls: DataFrame) -> DataFrame:
    """The lines, or an error that names the first bad one when they are read."""
    message = F.concat(F.lit("Invalid GEDCOM line "), F.col("pos"), F.lit(" of "), F.col("source"))
    return ls.withColumn("level", F.when(F.col("bad"), F.raise_error(message).cast("int")).otherwise(F.col("level"))).drop("bad")


def records(ls: DataFrame) -> DataFrame:
    """(source, ord, rec, pointer, tag, n_lines): the first line of each record decides."""
    first = F.min_by(F.struct("xref", "tag", "level"), "pos")
    return ls.groupBy("source", "ord", "rec").agg(first.alias("f"), F.count("*").alias("n_lines")).select("source", "ord", "rec", F.col("f.xref").alias("pointer"), F.col("f.tag").alias("tag"), "n_lines")


def envelope_faults(recs: DataFrame) -> DataFrame:
    """(source, fault): files without exactly one HEAD in front, exactly one TRLR at the end, or with a pointer declared twice."""
    per = recs.groupBy("source").agg(
        F.min_by("tag", "rec").alias("first"), F.max_by("tag", "rec").alias("last"), F.count_if(F.col("tag") == "HEAD").alias("heads"), F.count_if(F.col("tag") == "TRLR").alias("trlrs")
    )
    found = F.array_compact(F.array(
        F.when(F.col("first") != "HEAD", "MISSING_HEAD"), F.when(F.col("last") != "TRLR", "MISSING_TRLR"), F.when(F.col("heads") > 1, "DUPLICATE_HEAD"), F.when(F.col("trlrs") > 1, "DUPLICATE_TRLR"),
    ))
    twice = recs.where("pointer != ''").groupBy("source", "pointer").count().where("count > 1").select("source", F.lit("DUPLICATE_XREF").alias("fault")).distinct()
    return per.select("source", F.explode(found).alias("fault")).unionByName(twice)


def references(ls: DataFrame) -> DataFrame:
    """(source, ord, rec, pos, tag, pointer): lines whose whole value points to a record."""
    return ls.where((F.col("xref") == "") & F.col("tag").isin(*POINTER_TAGS) & F.trim("value").rlike(POINTER)).select("source", "ord", "rec", "pos", "tag", F.trim("value").alias("pointer"))


def global_pointers(ls: DataFrame) -> DataFrame:
    """(source, pointer, global): names that do not clash over the files.

    The first file that uses a pointer keeps it; later ones get its letters, their number and a counter. Pointers that are
    used but declared nowhere in their file are renamed too, so that none can bind to a record of another file. Only the
    pointers that clash, not all, are numbered.
    """
    declared = ls.where((F.col("level") == 0) & (F.col("xref") != "")).groupBy("source", "ord", F.col("xref").alias("pointer")).agg(F.min("pos").alias("pos"))
    used = references(ls).select("source", "ord", "pointer").distinct().join(declared.select("source", "pointer"), ["source", "pointer"], "left_anti")
    every = declared.select("source", "ord", "pointer", F.lit(0).alias("dangling"), "pos").unionByName(used.select("source", "ord", "pointer", F.lit(1).alias("dangling"), F.lit(0).alias("pos")))
    w = Window.partitionBy("pointer").orderBy("ord")
    marked = every.withColumn("k", F.row_number().over(w))
    letters = F.regexp_extract("pointer", r"^@([A-Za-z_]+)\d+@$", 1)
    prefix = F.concat(F.when(letters != "", letters).otherwise("X"), F.col("ord"), F.lit("_"))
    clash = marked.where("k > 1").withColumn("prefix", prefix)
    number = F.row_number().over(Window.partitionBy("source", "prefix").orderBy("dangling", "pos", "pointer"))
    renamed = clash.withColumn("global", F.concat(F.lit("@"), "prefix", number.cast("string"), F.lit("@")))
    # a name made here may be in use already; it gets as many letters x as make it longer than any name in use that begins so
    stem = F.regexp_replace("pointer", r"(_x+)?@$", "")
    taken = every.select(stem.alias("stem"), F.length(F.regexp_extract("pointer", r"_(x+)@$", 1)).alias("x")).groupBy("stem").agg(F.max("x").alias("x"))
    free = renamed.withColumn("stem", F.expr("left(global, length(global) - 1)")).join(taken, "stem", "left")
    safe = free.withColumn("global", F.when(F.col("x").isNull(), F.col("global")).otherwise(F.concat("stem", F.lit("_"), F.expr("repeat('x', x + 1)"), F.lit("@"))))
    return marked.where("k = 1").select("source", "pointer", F.col("pointer").alias("global")).unionByName(safe.select("source", "pointer", "global"))


def renamed(ls: DataFrame, names: DataFrame) -> DataFrame:
    """The lines with global pointers, in xrefs and pointer values only, never in other text."""
    n = names.select("source", F.col("pointer").alias("p"), "global")
    value = F.trim(F.col("value"))
    points = (F.col("xref") != "") | (F.col("tag").isin(*POINTER_TAGS) & value.rlike(POINTER))
    key = F.when(F.col("xref") != "", F.col("xref")).when(points, value)
    j = ls.withColumn("p", key).join(n, ["source", "p"], "left")
    xref = F.when((F.col("xref") != "") & F.col("global").isNotNull(), F.col("global")).otherwise(F.col("xref"))
    val = F.when((F.col("xref") == "") & F.col("global").isNotNull(), F.col("global")).otherwise(F.col("value"))
    return j.withColumn("xref", xref).withColumn("value", val).drop("p", "global")


def continued(ls: DataFrame) -> DataFrame:
    """(source, ord, rec, pos, level, xref, tag, text): CONC and CONT joined to the line they continue."""
    more = F.col("tag").isin("CONC", "CONT")
    w = Window.partitionBy("source", "rec").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    headed = ls.withColumn("head", F.sum(F.when(more, 0).otherwise(1)).over(w))
    piece = F.concat(F.when(F.col("tag") == "CONT", "\n").otherwise(""), F.coalesce("value", F.lit("")))
    return (
        headed.groupBy("source", "ord", "rec", "head")
        .agg(F.min_by(F.struct("pos", "level", "xref", "tag"), "pos").alias("f"), F.array_sort(F.collect_list(F.struct("pos", piece.alias("t")))).alias("parts"))
        .select("source", "ord", "rec", "f.pos", "f.level", "f.xref", "f.tag", F.array_join(F.col("parts.t"), "").alias("text"))
    )


def blocks(ls: DataFrame) -> DataFrame:
    """The continued lines with block: the number of their level-1 structure in the record, and its tag and text."""
    w = Window.partitionBy("source", "rec").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    top = F.when(F.col("level") == 1, F.struct("tag", "text"))
    return continued(ls).withColumn("block", F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(w)).withColumn("top", F.last(top, ignorenulls=True).over(w)).where("block > 0")


def facts(bs: DataFrame, recs: DataFrame, of: str = "INDI", tags: tuple[str, ...] = EVENT_TAGS) -> DataFrame:
    """(source, pointer, block, tag, value, date, place, country): the events of persons or families.

    The first DATE, PLAC and CTRY of a block count. Without a PLAC, address, city, state and country stand for it. A value
    of Y only says that the event happened.
    """
    first = lambda tag: F.coalesce(F.min_by(F.when(F.col("tag") == tag, F.trim("text")), F.when((F.col("tag") == tag) & (F.trim("text") != ""), F.col("pos"))), F.lit(""))
    inside = bs.where(F.col("top.tag").isin(*tags)).groupBy("source", "rec", "block").agg(
        F.first("top").alias("top"), *(first(t).alias(t) for t in ("DATE", "PLAC", "CTRY", "ADDR", "CITY", "STAE"))
    )
    address = F.array_join(F.filter(F.array("ADDR", "CITY", "STAE", "CTRY"), lambda x: x != ""), ", ")
    has_address = (F.col("ADDR") != "") | (F.col("CITY") != "") | (F.col("STAE") != "")
    value = F.trim(F.col("top.text"))
    inside = with_normalized_dates(inside, {"DATE": "standard"})
    return inside.join(recs.where(F.col("tag") == of).select("source", "rec", "pointer"), ["source", "rec"]).select(
        "source", "pointer", "block", F.col("top.tag").alias("tag"), F.when(F.upper(value) == "Y", "").otherwise(value).alias("value"), F.col("standard").alias("date"),
        F.when((F.col("PLAC") == "") & has_address, address).otherwise(F.col("PLAC")).alias("place"), F.col("CTRY").alias("country"),
    )


def names(bs: DataFrame, recs: DataFrame) -> DataFrame:
    """(source, pointer, block, value, given, surname, prefix, suffix, nickname, name_type, is_primary)."""
    part = lambda t: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("tag") == t) & (F.trim("text") != ""), F.struct("pos", F.trim("text").alias("t"))))), lambda x: x["t"]), "; ")
    grouped = bs.where(F.col("top.tag") == "NAME").groupBy("source", "rec", "block").agg(F.trim(F.first("top.text")).alias("value"), *(part(t).alias(t) for t in NAME_PARTS))
    surname = F.trim(F.regexp_extract("value", r"/([^/]*)/", 1))
    given = F.trim(F.regexp_replace(F.regexp_replace("value", r"/.*$", ""), r"\s+", " "))
    bare = ~F.col("value").contains("/")
    words = F.split("value", r"\s+")
    last = F.when(bare & (F.size(words) > 1), F.element_at(words, -1)).otherwise(surname)
    rest = F.when(bare & (F.size(words) > 1), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(given)
    w = Window.partitionBy("source", "rec").orderBy("block")
    return grouped.withColumn("k", F.row_number().over(w)).join(recs.where("tag = 'INDI'").select("source", "rec", "pointer"), ["source", "rec"]).select(
        "source", "pointer", "block", "value", F.when(F.col("GIVN") != "", F.col("GIVN")).otherwise(rest).alias("given"), F.when(F.col("SURN") != "", F.col("SURN")).otherwise(last).alias("surname"),
        F.col("NPFX").alias("prefix"), F.col("NSFX").alias("suffix"), F.col("NICK").alias("nickname"), F.lower("TYPE").alias("name_type"), (F.col("k") == 1).alias("is_primary"),
    )


def fullest(col_date: Column, col_place: Column, col_country: Column) -> Column:
    """Orders alternative events by how much they state: a date and its length, a place and its length, a country."""
    return F.struct((col_date != "").alias("d"), F.length(col_date).alias("dl"), (col_place != "").alias("p"), F.length(col_place).alias("pl"), (col_country != "").alias("c"))


def persons(bs: DataFrame, recs: DataFrame) -> DataFrame:
    """(source, pointer, given, surname, full_name, alternate_names, gender, birth_date, birth_place, death_date, death_place, cited): one row per INDI."""
    people = recs.where("tag = 'INDI' and pointer != ''").select("source", "pointer", "rec")
    ns = names(bs, recs)
    shown = F.trim(F.concat_ws(" ", "given", "surname"))
    primary = ns.where("is_primary").select("source", "pointer", "given", "surname")
    more = ns.where("not is_primary").groupBy("source", "pointer").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("block", shown.alias("n")))), lambda x: x["n"])).alias("alternate_names"))
    fs = facts(bs, recs, tags=("BIRT", "DEAT"))
    order = F.struct(fullest(F.col("date"), F.col("place"), F.col("country")).alias("f"), (-F.col("block")).alias("b"))
    best = fs.groupBy("source", "pointer", "tag").agg(F.max_by(F.struct("date", "place"), order).alias("e"))
    event = lambda t, n: best.where(F.col("tag") == t).select("source", "pointer", F.col("e.date").alias(f"{n}_date"), F.col("e.place").alias(f"{n}_place"))
    top = bs.groupBy("source", "rec").agg(F.max_by(F.when((F.col("level") == 1) & (F.col("tag") == "SEX"), F.upper(F.trim("text"))), F.when((F.col("level") == 1) & (F.col("tag") == "SEX"), F.col("pos"))).alias("gender"), F.max(F.col("tag") == "SOUR").alias("cited"))
    out = people.join(top, ["source", "rec"], "left").drop("rec")
    for extra in (primary, more, event("BIRT", "birth"), event("DEAT", "death")):
        out = out.join(extra, ["source", "pointer"], "left")
    text = ["given", "surname", "gender", "birth_date", "birth_place", "death_date", "death_place"]
    out = out.fillna("", text).withColumn("alternate_names", F.coalesce("alternate_names", F.array().cast("array<string>"))).withColumn("cited", F.coalesce("cited", F.lit(False)))
    return out.withColumn("full_name", shown).select("source", "pointer", "given", "surname", "full_name", "alternate_names", "gender", "birth_date", "birth_place", "death_date", "death_place", "cited")


def family_edges(bs: DataFrame, recs: DataFrame) -> DataFrame:
    """(source, family, person, role): what families say of their members; role is HUSB, WIFE or CHIL."""
    m = bs.where((F.col("level") == 1) & F.col("tag").isin("HUSB", "WIFE", "CHIL") & F.trim("text").rlike(POINTER))
    return m.join(recs.where("tag = 'FAM'").select("source", "rec", F.col("pointer").alias("family")), ["source", "rec"]).select("source", "family", F.trim("text").alias("person"), F.col("tag").alias("role")).distinct()


def person_edges(bs: DataFrame, recs: DataFrame) -> DataFrame:
    """(source, person, family, role, pedigree): what persons say of their families; role is FAMS or FAMC."""
    top = bs.where(F.col("top.tag").isin("FAMS", "FAMC")).groupBy("source", "rec", "block").agg(F.first("top").alias("top"), F.max(F.when(F.col("tag") == "PEDI", F.lower(F.trim("text")))).alias("pedigree"))
    return top.join(recs.where("tag = 'INDI'").select("source", "rec", F.col("pointer").alias("person")), ["source", "rec"]).where(F.trim("top.text") != "").select(
        "source", "person", F.trim("top.text").alias("family"), F.col("top.tag").alias("role"), F.coalesce("pedigree", F.lit("")).alias("pedigree")
    )


def parent_edges(fam: DataFrame) -> DataFrame:
    """(source, family, parent, child) of all parents and children of a family."""
    p = fam.where("role in ('HUSB', 'WIFE')").select("source", "family", F.col("person").alias("parent"))
    return p.join(fam.where("role = 'CHIL'").select("source", "family", F.col("person").alias("child")), ["source", "family"])


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of several files with pointers that do not clash."""
    ls = strict(lines(read_texts(spark, paths)))
    found = over_budget(ls).limit(5).collect()
    if found:
        raise GedcomError("; ".join(f"{r['source']}, record {r['rec']}: {r['value']} {r['what']}" for r in found))
    return renamed(ls, global_pointers(ls))
