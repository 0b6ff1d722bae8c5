"""The best representative of each duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.dates import NONE, with_dates
from stemma.functions.text import fold
from stemma.llm.places import read_places, reader_for
from stemma.tables import settle

FIELDS = ("birth_date", "birth_place", "death_date", "occupation")
# Texts in an occupation that state none.
NO_OCCUPATION = ("", "none", "none given", "not given", "not stated", "no occupation", "unknown", "unbekannt", "unbek", "inconnu", "desconocido", "n a", "na", "nil", "blank", "illegible", "no record", "unk", "ohne", "sans", "keine", "ninguna", "no date", "n d")


def best_values(groups: DataFrame, records: DataFrame, places: DataFrame, values_too: bool = True) -> DataFrame:
    """(canonical_ref, field_name, source_ref, value): the record whose value survives, for each group and field.

    Groups are the distinct source_refs of each canonical_ref that records hold; fewer than two give no rows. Repeated
    rows and refs, nulls and refs that no record has do no harm. The records of a group and field are ranked by
    completeness of the value, quay, changed_at (nulls last) and source_ref; the window keeps the first, and Spark drops
    all but each task's best before the shuffle, so a huge group costs no task more than its own rows. Values
    that state nothing never win. Without values_too the texts stay out of every shuffle, and value is left out.
    """
    members = (
        groups.where(F.col("canonical_ref").isNotNull())
        .select("canonical_ref", F.explode("source_refs").alias("source_ref"))
        .where(F.col("source_ref").isNotNull())
        .distinct()
    )
    text = F.trim(F.coalesce(F.col("occupation"), F.lit("")))
    told = F.when(text.rlike(r"[\p{L}\p{N}]") & ~F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " ")).isin(*NO_OCCUPATION), 1).otherwise(0)
    stated = records.where(F.trim("birth_place") != "").groupBy(F.col("birth_place").alias("value")).agg(F.count("*").alias("n"))
    # used twice
    levels = settle(read_places(stated, reader_for(places)).select(F.col("value").alias("birth_place"), "levels"))
    rows = (
        with_dates(records.where(F.col("source_ref").isNotNull()).select("source_ref", "quay", "changed_at", *FIELDS), {"birth_date": "born", "death_date": "died"})
        .join(levels, "birth_place", "left")
        .select(
            "source_ref", "quay", "changed_at", *(FIELDS if values_too else ()), F.col("born.precision").alias("full_birth_date"), F.col("died.precision").alias("full_death_date"),
            told.alias("full_occupation"), F.coalesce("levels", F.lit(0)).alias("full_birth_place"),
        )
    )
    # a ref counts for its group if some record has it; repeated imports of one ref count once
    found = members.join(rows, "source_ref")
    wide = found.groupBy("canonical_ref").agg(F.min("source_ref").alias("a"), F.max("source_ref").alias("b")).where("a != b").select("canonical_ref")
    values = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"full_{f}").alias("full"), *([F.col(f).alias("value")] if values_too else [])) for f in FIELDS))
    cells = (
        found.join(wide, "canonical_ref", "left_semi")
        .select("canonical_ref", "source_ref", "quay", "changed_at", F.explode(values).alias("v"))
        .where(F.col("v.full") > NONE)
    )
    w = Window.partitionBy("canonical_ref", "field_name").orderBy(F.desc("full"), F.desc_nulls_last("quay"), F.desc_nulls_last("changed_at"), "source_ref")
    keep = ["canonical_ref", "field_name", "source_ref", *(["value"] if values_too else [])]
    return (
        cells.select("canonical_ref", "source_ref", "quay", "changed_at", "v.*").withColumn("k", F.row_number().over(w)).where("k = 1").select(*keep)
    )


def survivors(groups: DataFrame, records: DataFrame, places: DataFrame) -> DataFrame:
    """One row per group: the surviving value of each field and the record it comes from; null where nothing is stated."""
    return best_values(groups, records, places).groupBy("canonical_ref").agg(
        *(F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in FIELDS),
        *(F.max(F.when(F.col("field_name") == f, F.col("source_ref"))).alias(f"{f}_from") for f in FIELDS),
    )
