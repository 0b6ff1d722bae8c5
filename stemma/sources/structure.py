"""Structures inside GEDCOM records: level-1 blocks with their keys, children at any level, identifiers, dates with their originals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.dates import with_normalized_dates
from stemma.functions.normal import normal_space, with_normal_values
from stemma.sources import gedcom

# Children that are merged on their own, tags of stable identifiers, children that tell a fact's place in a life.
ATTACHMENT_TAGS = ("NOTE", "OBJE", "SOUR")
STABLE_ID_TAGS = ("REFN", "_APID", "_FSFTID", "_MHID", "_UID")
SLOT_TAGS = ("ADDR", "DATE", "PLAC", "TYPE")
CITATION_TAGS = ("PAGE", "EVEN", "ROLE")


def relative(ls: DataFrame) -> DataFrame:
    """(source, ord, rec, pos, level, xref, tag, text, normal): continued lines joined, with the value in its comparable form."""
    return with_normal_values(gedcom.continued(ls), "tag", "text", "normal")


def children(ls: DataFrame, at: int) -> DataFrame:
    """Lines (source, rec, pos, level, ...) below level `at`, with child: the number of their structure directly below it in the record, and child_tag."""
    w = Window.partitionBy("source", "rec").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = ls.withColumn("child", F.sum(F.when(F.col("level") <= at + 1, 1).otherwise(0)).over(w)).withColumn("child_tag", F.last(F.when(F.col("level") <= at + 1, F.col("tag")), ignorenulls=True).over(w))
    return numbered.where(F.col("level") > at)


def _text(rows: Column) -> Column:
    """Collected structs (pos, t) as one text, a line each."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["t"]), "\n")


def record_blocks(ls: DataFrame) -> DataFrame:
    """(source, ord, rec, pointer, record, block, tag, key, logical, whole, cited, lines): one row per level-1 structure.

    key is the hash of what the block says without notes, media and citations, logical that of its place in a life (tag, type,
    date, place, address), whole that of everything. lines is array<struct<pos, level, tag, text>>. Values are hashed in
    their comparable form, levels from the block on.
    """
    w = Window.partitionBy("source", "rec").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rel = relative(ls).withColumn("block", F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(w))
    head = rel.where("level = 0").select("source", "rec", F.col("xref").alias("pointer"), F.col("tag").alias("record"))
    inner = Window.partitionBy("source", "rec", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    below = rel.where("block > 0").withColumn("child", F.last(F.when(F.col("level") == 2, F.col("tag")), ignorenulls=True).over(inner))
    line = F.rtrim(F.concat((F.col("level") - 1).cast("string"), F.lit(" "), "tag", F.lit(" "), "normal"))
    attached = F.coalesce(F.col("child").isin(*ATTACHMENT_TAGS), F.lit(False))
    t = F.struct("pos", line.alias("t"))
    slot = F.when(F.col("level") == 1, F.struct("pos", F.concat(F.lit("0 "), "tag").alias("t"))).when(F.col("child").isin(*SLOT_TAGS), t)
    grouped = below.groupBy("source", "ord", "rec", "block").agg(
        F.min_by("tag", "pos").alias("tag"), F.sha2(_text(F.when(~attached, t)), 256).alias("key"), F.sha2(_text(slot), 256).alias("logical"), F.sha2(_text(t), 256).alias("whole"),
        F.max((F.col("level") > 1) & (F.col("tag") == "SOUR")).alias("cited"), F.array_sort(F.collect_list(F.struct("pos", "level", "tag", "text"))).alias("lines"),
    )
    return grouped.join(head, ["source", "rec"]).select("source", "ord", "rec", "pointer", "record", "block", "tag", "key", "logical", "whole", "cited", "lines")


def identifiers(blocks: DataFrame) -> DataFrame:
    """(pointer, id): stable identifiers that records carry, as tag and value."""
    first = F.element_at("lines", 1)["text"]
    value = normal_space(first)
    return blocks.where(F.col("tag").isin(*STABLE_ID_TAGS)).select("pointer", F.concat_ws(":", "tag", value).alias("id"), value.alias("v")).where("v != ''").select("pointer", "id").distinct()


def citations(blocks: DataFrame) -> DataFrame:
    """(source, ord, rec, pointer, block, key, child, identity, structure): the citations of each block; identity is source, page, event and role."""
    rows = blocks.select("source", "ord", "rec", "pointer", "block", "key", F.explode("lines").alias("l")).select("source", "ord", "rec", "pointer", "block", "key", "l.*")
    w = Window.partitionBy("source", "rec", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("child", F.sum(F.when(F.col("level") == 2, 1).otherwise(0)).over(w)).withColumn("child_tag", F.last(F.when(F.col("level") == 2, F.col("tag")), ignorenulls=True).over(w))
    cited = with_normal_values(numbered.where("child > 0 and child_tag = 'SOUR'"), "tag", "text", "normal")
    first = lambda tag: F.coalesce(F.min_by(F.when(F.col("tag") == tag, F.col("normal")), F.when(F.col("tag") == tag, F.col("pos"))), F.lit(""))
    line = F.struct("pos", F.concat_ws(" ", (F.col("level") - 2).cast("string"), "tag", "normal").alias("t"))
    return cited.groupBy("source", "ord", "rec", "pointer", "block", "key", "child").agg(F.concat_ws("\n", first("SOUR"), *(first(t) for t in CITATION_TAGS)).alias("identity"), F.sha2(_text(line), 256).alias("structure"))


def with_original_dates(ls: DataFrame) -> DataFrame:
    """The lines with birth and death dates in the standard form; a date that changed is kept behind it as _ORIGDATE.

    Only DATE lines directly below a level-1 BIRT or DEAT count. i orders the two lines of one pos. Dates that can't be read stay.
    """
    w = Window.partitionBy("source", "rec").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    dated = with_normalized_dates(ls.withColumn("__event", F.last(F.when(F.col("level") <= 1, F.col("tag")), ignorenulls=True).over(w)), {"value": "__date"})
    change = (F.col("level") == 2) & (F.col("tag") == "DATE") & F.col("__event").isin("BIRT", "DEAT") & (F.coalesce(F.trim("__date"), F.lit("")) != "") & (F.col("__date") != F.col("value"))
    lines = F.when(change, F.array(F.struct(F.lit(0).alias("i"), F.lit("DATE").alias("t"), F.col("__date").alias("v")), F.struct(F.lit(1).alias("i"), F.lit("_ORIGDATE").alias("t"), F.col("value").alias("v")))).otherwise(
        F.array(F.struct(F.lit(0).alias("i"), F.col("tag").alias("t"), F.col("value").alias("v")))
    )
    return dated.withColumn("__l", F.explode(lines)).withColumn("i", F.col("__l.i")).withColumn("tag", F.col("__l.t")).withColumn("value", F.col("__l.v")).drop("__l", "__event", "__date")


def header_dates(ls: DataFrame) -> DataFrame:
    """(source, exported_at): the standard form of the date that each file's HEAD gives; files without one have no row."""
    heads = gedcom.records(ls).where("tag = 'HEAD'").groupBy("source").agg(F.min("rec").alias("rec"))
    dates = ls.join(heads, ["source", "rec"], "left_semi").where("level = 1 and tag = 'DATE' and trim(value) != ''").groupBy("source").agg(F.min_by(F.trim("value"), "pos").alias("value"))
    return with_normalized_dates(dates, {"value": "exported_at"}).select("source", "exported_at")


def person_summary(people: DataFrame) -> DataFrame:
    """(source, pointer, summary): one line on each person: name, sex, birth and death with dates and places, as far as stated."""
    part = lambda label, date, place: F.when((F.col(date) != "") | (F.col(place) != ""), F.concat(F.lit(label), F.concat_ws(" in ", F.when(F.col(date) != "", F.col(date)), F.when(F.col(place) != "", F.col(place)))))
    name = F.when(F.col("full_name") != "", F.col("full_name")).otherwise("unnamed")
    sex = F.when(F.col("gender") != "", F.concat(F.lit("sex "), "gender"))
    return people.select("source", "pointer", F.concat_ws("; ", name, sex, part("born ", "birth_date", "birth_place"), part("died ", "death_date", "death_place")).alias("summary"))
