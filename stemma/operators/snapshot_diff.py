"""What changed between full snapshots, by grouped sums of signed cells."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a record that decide whether it changed; xref is new in every export and never counts.
FIELDS = ("kind", "label", "event_date", "event_place", "attributes")
_SPACE = re.compile(r"[\s​­﻿]+")


@F.pandas_udf(T.StringType())
def canonical_text(text: pd.Series) -> pd.Series:
    """Composed, case-folded text without any white space; null stays null."""
    nfc, space = unicodedata.normalize, _SPACE
    return text.map(lambda s: s if s is None else nfc("NFC", nfc("NFC", space.sub("", s)).casefold()))


def transitions(manifests: DataFrame) -> DataFrame:
    """(tree_id, source_id, generation, prev_snapshot_id, snapshot_id): each two different snapshots in force one after the other.

    Repeated manifest rows, null maps and generations without a change give nothing. A source that is missing in some
    generations goes on from the last snapshot it had. If a source names several snapshots in one generation, the smallest counts.
    """
    force = (
        manifests.where(F.col("generation").isNotNull())
        .select("tree_id", "generation", F.explode("active_snapshots").alias("source_id", "snapshot_id"))
        .where(F.col("snapshot_id").isNotNull())
        .groupBy("tree_id", "source_id", "generation")
        .agg(F.min("snapshot_id").alias("snapshot_id"))
    )
    w = Window.partitionBy("tree_id", "source_id").orderBy("generation")
    return (
        force.withColumn("prev_snapshot_id", F.lag("snapshot_id").over(w))
        .where(F.col("prev_snapshot_id").isNotNull() & (F.col("prev_snapshot_id") != F.col("snapshot_id")))
        .select("tree_id", "source_id", "generation", "prev_snapshot_id", "snapshot_id")
    )


def _escaped(text: Column) -> Column:
    """Text without the bytes that part fields and attributes; different texts stay different."""
    out = F.replace(text, F.lit("\x03"), F.lit("\x03c"))
    return F.replace(F.replace(out, F.lit("\x01"), F.lit("\x03a")), F.lit("\x02"), F.lit("\x03b"))


def _cells(records: DataFrame) -> DataFrame:
    """One row per record: snapshot_id, uid and a 64-bit hash of each canonical field.

    Attributes are an unordered list of texts; null, blank and empty are alike. The five texts go through one
    Arrow call, joined by a separator, because Unicode composition has no JVM expression.
    """
    attributes = F.array_join(F.transform(F.coalesce(F.col("attributes"), F.array().cast("array<string>")), _escaped), "\x02")
    joined = canonical_text(F.concat_ws("\x01", *(_escaped(F.coalesce(F.col(f), F.lit(""))) for f in FIELDS[:-1]), attributes))
    parts = records.select("snapshot_id", "uid", F.split(joined, "\x01").alias("p"))
    hashes: list[Column] = [F.xxhash64(F.get("p", F.lit(i))).alias(f"h{i}") for i in range(len(FIELDS) - 1)]
    listed = F.array_sort(F.filter(F.split(F.coalesce(F.get("p", F.lit(len(FIELDS) - 1)), F.lit("")), "\x02"), lambda a: a != ""))
    return parts.select("snapshot_id", "uid", *hashes, F.xxhash64(F.array_join(listed, "\x02")).alias(f"h{len(FIELDS) - 1}"))


def snapshot_changes(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(prev_snapshot_id, snapshot_id, uid, change_kind, changed_fields) for the transitions in `pairs`.

    Each record becomes a presence marker and one cell per field, signed + in the later and - in the earlier snapshot.
    Sums over equal cells vanish where nothing changed. A nonzero presence sum means created or removed, other
    nonzero sums mean updated and name the fields. Repeated records of a snapshot count once; rows without uid or
    of snapshots outside `pairs` give nothing. The one shuffle is by transition and uid, so no source can be a hot spot.
    """
    steps = pairs.select("prev_snapshot_id", "snapshot_id").distinct()
    sides = steps.select(
        F.xxhash64("prev_snapshot_id", "snapshot_id").alias("step"),
        F.explode(
            F.array(
                F.struct(F.col("prev_snapshot_id").alias("sid"), F.lit(-1).cast("tinyint").alias("sign")),
                F.struct(F.col("snapshot_id").alias("sid"), F.lit(1).cast("tinyint").alias("sign")),
            )
        ).alias("side"),
    ).select("step", "side.sid", "side.sign")
    signed = (
        _cells(records.where(F.col("uid").isNotNull()))
        .join(sides, F.col("snapshot_id") == F.col("sid"))
        .drop("snapshot_id", "sid")
        .repartition("step", "uid")
    )
    names = ("", *FIELDS)
    cells = F.array(*(F.struct(F.lit(n).alias("field"), (F.lit(0).cast("long") if i == 0 else F.col(f"h{i - 1}")).alias("value")) for i, n in enumerate(names)))
    sums = (
        signed.select("step", "uid", "sign", F.explode(cells).alias("cell"))
        .groupBy("step", "uid", "cell.field", "cell.value")
        # a repeated record must not count twice, so each side adds its sign at most once
        .agg((F.max(F.when(F.col("sign") > 0, 1).otherwise(0)) - F.max(F.when(F.col("sign") < 0, 1).otherwise(0))).alias("net"))
        .where("net != 0")
    )
    changed = sums.groupBy("step", "uid").agg(
        F.max(F.when(F.col("field") == "", F.col("net"))).alias("presence"),
        F.array_sort(F.collect_set(F.when(F.col("field") != "", F.col("field")))).alias("changed_fields"),
    )
    kind = F.when(F.col("presence") > 0, "created").when(F.col("presence") < 0, "removed").otherwise("updated")
    return changed.join(steps.withColumn("step", F.xxhash64("prev_snapshot_id", "snapshot_id")), "step").select(
        "prev_snapshot_id", "snapshot_id", "uid", kind.alias("change_kind"),
        F.when(F.col("presence").isNull(), F.col("changed_fields")).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
    )
