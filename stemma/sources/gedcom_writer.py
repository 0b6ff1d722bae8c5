"""Writing GEDCOM: lines of at most 255 bytes, checked, in one ordered text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.sources.gedcom import GedcomError

# Fixed values of the format.
MAX_BYTES, MAX_LEVEL, MAX_XREF, MAX_TAG = 255, 99, 22, 31
XREF = r"^@[A-Za-z_][A-Za-z0-9_:-]*@$"
VERSIONS = ("5.5.1", "5.5.5")
#: Sections of a file in order; records that are neither stand before the trailer.
SECTIONS = {"HEAD": 0, "SUBM": 1, "INDI": 2, "FAM": 3, "TRLR": 9}


def cut_bytes(text: str, first: int, rest: int) -> list[str]:
    """Pieces of a text of at most `first`, then `rest` bytes each, cut between characters only."""
    data, out, at, room = text.encode("utf-8"), [], 0, first
    while len(data) - at > room:
        end = at + room
        while end > at and data[end] & 0xC0 == 0x80:
            end -= 1
        if end == at:
            raise GedcomError("a line cannot hold one character")
        out.append(data[at:end].decode("utf-8"))
        at, room = end, rest
    return [*out, data[at:].decode("utf-8")]


def wrapped(level: int, xref: str, tag: str, value: str) -> list[str]:
    """The physical lines of one value: line ends become CONT, and what is too long CONC, one level below."""
    head = " ".join(str(p) for p in (level, xref, tag) if p != "" and p is not None)
    below = f"{level + 1} "
    out = []
    for i, line in enumerate((value or "").split("\n")):
        start = head if i == 0 else below + "CONT"
        pieces = cut_bytes(line, MAX_BYTES - len(start.encode()) - 1, MAX_BYTES - len(below) - 5)
        if level >= MAX_LEVEL and (i or len(pieces) > 1):
            raise GedcomError("a value at level 99 cannot go on")
        out.append(f"{start} {pieces[0]}" if pieces[0] else start)
        out.extend(f"{below}CONC {p}" for p in pieces[1:])
    return out


def wrap_notes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line): each text as a note at level 1, wrapped; null and empty texts give one bare line."""
    schema = texts.select(key, F.lit(0).alias("pos"), F.lit("").alias("line")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, line) for k, t in zip(b[key], b[text], strict=True) for i, line in enumerate(wrapped(1, "", "NOTE", t or ""))]
            yield pd.DataFrame(rows, columns=[key, "pos", "line"]).astype({"pos": "int32"})

    return texts.select(key, text).mapInPandas(run, schema)


# Head structures that may stand once, and those that the writer sets itself.
ONCE_IN_HEAD, SET_IN_HEAD = ("SOUR", "DEST", "DATE", "SUBM", "FILE", "COPR", "LANG", "PLAC"), ("GEDC", "CHAR")


def head_blocks(ls: DataFrame) -> DataFrame:
    """(ord, rec, block, tag, lines): the head structures of all files that one head keeps: the first of what may stand once, others once each."""
    w = Window.partitionBy("source", "rec").orderBy("pos")
    head = ls.withColumn("__rec", F.first("tag").over(w)).where("__rec = 'HEAD' and level > 0")
    numbered = head.withColumn("block", F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = numbered.where("block > 0").groupBy("ord", "rec", "block").agg(F.min_by("tag", "pos").alias("tag"), F.array_sort(F.collect_list(F.struct("pos", "level", "tag", F.coalesce("value", F.lit("")).alias("value")))).alias("lines")).where(~F.col("tag").isin(*SET_IN_HEAD))
    what = F.when(F.col("tag").isin(*ONCE_IN_HEAD), F.col("tag")).otherwise(F.sha2(F.to_json(F.transform("lines", lambda x: F.struct(x["level"].alias("l"), x["tag"].alias("t"), x["value"].alias("v")))), 256))
    first = blocks.groupBy(what.alias("__what")).agg(F.min(F.struct("ord", "rec", "block", "tag", "lines")).alias("b"))
    return first.select("b.*")


def _submitter(ls: DataFrame, asked: str) -> tuple[str, bool]:
    """The pointer of the submitter, and whether its record must be made: the one asked for if it is one or free, else a new one."""
    own = ls.where((F.col("level") == 0) & (F.col("xref") == asked)).select("tag").limit(1).collect()
    if not own:
        return asked, True
    if own[0]["tag"] == "SUBM":
        return asked, False
    number = F.regexp_extract("xref", r"^@U1_(\d{1,9})@$", 1).try_cast("int")
    return f"@U1_{(ls.where('level = 0').agg(F.max(number)).first()[0] or 0) + 1}@", True


def file_lines(ls: DataFrame, version: str = "5.5.5") -> DataFrame:
    """(section, ord, rec, pos, i, line): the lines of one file from those of several, in the order of sections.

    One HEAD is made: what may stand once has the first file's value, other structures stay once each; version and character set are
    the writer's. It names a submitter, who gets a record if there is none. Repeated heads and trailers are dropped.
    """
    if version not in VERSIONS:
        raise GedcomError(f"version {version}")
    spark = ls.sparkSession
    tag = F.first("tag").over(Window.partitionBy("source", "rec").orderBy("pos"))
    body = ls.withColumn("rec_tag", tag).where("rec_tag not in ('HEAD', 'TRLR')")
    section = F.when(F.col("rec_tag") == "SUBM", 1).when(F.col("rec_tag") == "INDI", 2).when(F.col("rec_tag") == "FAM", 3).otherwise(4)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, o, r, p, level, xref, t, v in zip(*(b[c] for c in ("section", "ord", "rec", "pos", "level", "xref", "tag", "value")), strict=True):
                rows += [(s, o, r, p, i, line) for i, line in enumerate(wrapped(level, xref, t, v))]
            yield pd.DataFrame(rows, columns=["section", "ord", "rec", "pos", "i", "line"])

    schema = "section int, ord int, rec long, pos int, i int, line string"
    columns = ["section", "ord", "rec", "pos", "level", "xref", "tag", "value"]
    kept = head_blocks(ls)
    named = kept.where("tag = 'SUBM'").select(F.element_at("lines", 1)["value"]).limit(1).collect()
    asked = named[0][0].strip() if named else ""
    if not asked:
        one = ls.where("level = 0 and tag = 'SUBM'").orderBy("ord", "rec").select("xref").limit(1).collect()
        asked = one[0]["xref"] if one else "@U1@"
    who, make = _submitter(ls, asked)
    # the head's structures stand in the order of files; ord and rec 0 keep the writer's own lines around them
    value = F.when(F.col("l.tag") == "SUBM", F.lit(who)).otherwise(F.col("l.value"))
    heads = kept.select("ord", "rec", "block", F.explode("lines").alias("l")).select(F.lit(0).alias("section"), "ord", F.col("rec").cast("long").alias("rec"), F.col("l.pos").cast("int").alias("pos"), "l.level", F.lit("").alias("xref"), "l.tag", value.alias("value"))
    written = body.select(section.alias("section"), *columns[1:]).unionByName(heads).mapInPandas(run, schema)
    last = 1_000_000_000
    fixed = [(0, 0, 0, 0, 0, "0 HEAD")]
    fixed += [] if named else [(0, last, 0, 0, 0, f"1 SUBM {who}")]
    fixed += [(0, last, 0, 1 + n, 0, line) for n, line in enumerate(("1 GEDC", f"2 VERS {version}", "1 CHAR UTF-8"))]
    fixed += [] if kept.where("tag = 'SOUR'").limit(1).count() else [(0, 0, 0, 1, 0, "1 SOUR STEMMA")]
    fixed += [(1, 0, 0, 0, 0, f"0 {who} SUBM"), (1, 0, 0, 1, 0, "1 NAME Unknown")] if make else []
    return written.unionAll(spark.createDataFrame([*fixed, (9, 0, 0, 0, 0, "0 TRLR")], schema))


def person_lines(people: DataFrame) -> DataFrame:
    """(source, ord, rec, pos, level, xref, tag, value): records of persons that are known by their fields only.

    people has pointer, full_name, given, surname, gender, alternate_names, birth_date, birth_place, death_date and death_place, and may have facts,
    array<struct<tag, value, date, place, country>>, and families, array<struct<tag, pointer>> of FAMS and FAMC. A country stands below its place, or
    as the place where there is none. Fields that are not stated are left out.
    """
    no = F.lit("")
    typed = "array<struct<level: int, xref: string, tag: string, value: string>>"
    line = lambda level, tag, value: F.struct(F.lit(level).alias("level"), no.alias("xref"), (tag if isinstance(tag, Column) else F.lit(tag)).alias("tag"), F.coalesce(value, no).alias("value"))
    some = lambda c: F.coalesce(c, no) != ""
    text = lambda c: F.coalesce(F.col(c), no)
    name = F.when(some(F.col("surname")), F.trim(F.concat(text("given"), F.lit(" /"), text("surname"), F.lit("/")))).otherwise(text("given"))
    shown = F.when(name != "", name).otherwise(text("full_name"))
    names = F.when(shown != "", F.array(line(1, "NAME", shown), *(F.when(some(F.col(c)), line(2, t, F.col(c))) for c, t in (("given", "GIVN"), ("surname", "SURN")))))
    others = F.transform(F.filter(F.coalesce("alternate_names", F.array().cast("array<string>")), lambda n: (n != "") & (n != F.coalesce("full_name", no))), lambda n: line(1, "NAME", n))
    sex = F.when(some(F.col("gender")), F.array(line(1, "SEX", F.col("gender"))))

    def event(tag, value, date, place, land):  # noqa: ANN001, ANN202
        return F.array(
            line(1, tag, value), F.when(some(date), line(2, "DATE", date)), F.when(some(place), line(2, "PLAC", place)).when(some(land), line(2, "PLAC", land)), F.when(some(place) & some(land), line(3, "CTRY", land))
        )

    vital = [F.when(some(F.col(f"{n}_date")) | some(F.col(f"{n}_place")), event(t, no, F.col(f"{n}_date"), F.col(f"{n}_place"), no)) for n, t in (("birth", "BIRT"), ("death", "DEAT"))]
    more = []
    if "facts" in people.columns:
        told = F.array_sort(F.coalesce("facts", F.array().cast("array<struct<tag: string, value: string, date: string, place: string, country: string>>")))
        more.append(F.flatten(F.transform(F.filter(told, lambda f: ~f["tag"].isin("BIRT", "DEAT")), lambda f: event(f["tag"], f["value"], f["date"], f["place"], f["country"]))))
    if "families" in people.columns:
        links = F.filter(F.coalesce("families", F.array().cast("array<struct<tag: string, pointer: string>>")), lambda f: f["tag"].isin("FAMS", "FAMC") & some(f["pointer"]))
        more.append(F.transform(links, lambda f: line(1, f["tag"], f["pointer"])))
    first = F.array(F.struct(F.lit(0).alias("level"), F.col("pointer").alias("xref"), F.lit("INDI").alias("tag"), no.alias("value")))
    none = F.array().cast(typed)
    every = F.array_compact(F.concat(*(F.coalesce(x.cast(typed), none) for x in (first, names, others, sex, *vital, *more))))
    from stemma.operators.relations import ranked

    return ranked(people.where("pointer is not null and pointer != ''"), ["pointer"], "rec").select(F.lit("people").alias("source"), F.lit(1).alias("ord"), F.col("rec").cast("long").alias("rec"), F.posexplode(every).alias("pos", "l")).select("source", "ord", "rec", "pos", "l.*")


def faults(ls: DataFrame, version: str = "5.5.5") -> DataFrame:
    """(pos, fault): what keeps parsed lines of one file from being valid; empty for a valid file."""
    w = Window.partitionBy("source").orderBy("pos")
    before = F.coalesce(F.lag("level").over(w), F.lit(-1))
    checks = {
        "BAD_LINE": F.col("bad"), "LONG_LINE": F.octet_length("raw") > MAX_BYTES, "LONG_TAG": F.length("tag") > MAX_TAG,
        "LOWER_TAG": F.regexp_extract("raw", r"^\d+\s+(?:@[^@\s]+@\s+)?(\S+)", 1) != F.col("tag"), "XREF_LEVEL": (F.col("xref") != "") & (F.col("level") > 0),
        "MALFORMED_XREF": (F.col("xref") != "") & ((F.length("xref") > MAX_XREF) | ~F.col("xref").rlike(XREF)), "LEVEL_SKIP": F.col("level") > before + 1,
    }
    marked = ls.withColumn("f", F.array_compact(F.array(*(F.when(c, n) for n, c in checks.items()))))
    rows = marked.select("pos", F.explode("f").alias("fault"))
    under = F.last(F.when(F.col("level") == 1, F.col("tag")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    seen = ls.withColumn("under", under).agg(
        F.count_if((F.col("level") == 0) & (F.col("tag") == "HEAD")).alias("heads"), F.count_if((F.col("level") == 0) & (F.col("tag") == "TRLR")).alias("ends"), F.min_by("tag", "pos").alias("first"),
        F.max_by("tag", "pos").alias("last"), F.max(F.when((F.col("level") == 2) & (F.col("under") == "GEDC") & (F.col("tag") == "VERS"), F.trim("value"))).alias("version"),
        F.max(F.when((F.col("level") == 1) & (F.col("tag") == "CHAR"), F.upper(F.trim("value")))).alias("charset"), (F.count(F.when(F.col("xref") != "", 1)) - F.countDistinct(F.when(F.col("xref") != "", F.col("xref")))).alias("twice"),
    )
    whole = F.array_compact(F.array(
        F.when((F.col("heads") != 1) | (F.col("first") != "HEAD"), "HEAD"), F.when((F.col("ends") != 1) | (F.col("last") != "TRLR"), "TRLR"), F.when(~F.col("version").eqNullSafe(version), "VERSION"),
        F.when(~F.col("charset").eqNullSafe("UTF-8"), "CHARSET"), F.when(F.col("twice") > 0, "DUPLICATE_XREF"),
    ))
    return rows.unionAll(seen.select(F.lit(0).alias("pos"), F.explode(whole).alias("fault")))


def write_gedcom(ls: DataFrame, path: str, version: str = "5.5.5") -> None:
    """Writes one text file below `path`, sorted by section, file, record and line; the sort is distributed, the file is one."""
    file_lines(ls, version).orderBy("section", "ord", "rec", "pos", "i").select("line").coalesce(1).write.text(path)
