"""The queries of this subpackage: each applies an operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import components, matching, mixing, packing, places, subjects, survivors, variants
from stemma.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with their confidence."""
    left = table(spark, d, "individuals").withColumnRenamed("individual_id", "id")
    right = table(spark, d, "rm_persons").withColumnRenamed("personid", "id")
    evidence = table(spark, d, "nametable").where("name_type = 'person'")
    return matching.match(left, right, table(spark, d, "placetable"), evidence=evidence).select(F.col("left_id").alias("individual_id"), F.col("right_id").alias("personid"), "confidence")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("individual_id", "personid")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return places.map_places(table(spark, d, "individuals").select("individual_id", "birth_place"), table(spark, d, "placetable")).select("individual_id", "placeid")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its class."""
    evidence = table(spark, d, "individuals").select("full_name", "alternate_names").unionAll(table(spark, d, "rm_persons").select("full_name", "alternate_names"))
    return variants.name_classes(table(spark, d, "nametable"), evidence=evidence)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.class_pairs(p3_classes(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.best_values(table(spark, d, "identities"), table(spark, d, "individuals"), table(spark, d, "placetable"), values_too=False)


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "identities"), table(spark, d, "individuals"), table(spark, d, "placetable"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return components.group_refs(table(spark, d, "match_links"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_containers(table(spark, d, "documents"), table(spark, d, "container_specs"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d), table(spark, d, "container_specs"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(p8_mixture(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas")).select("doc_id", "subject_code")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters by subject, a document with several subjects counted under each."""
    found = p9_found(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return found.groupBy("subject_code").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_matches, p2_found, p3_found, p3_classes, p4_found, p4_survivors, p6_found, p7_containers, p7_fill, p8_mixture, p8_shares, p9_found, p9_composition)}
#: Plain SQL can say the components by closure; the other operators are tested against brute force and planted cases.
SQL: dict[str, str] = {
    "p6_found": """
with recursive l as (select list_filter(coalesce(source_refs, []), lambda x: x is not null) refs, canonical_ref, disposition from match_links),
m as (select refs, canonical_ref, refs[1] f from l where disposition = 'merged' and len(refs) > 0),
e as (select f a, unnest(refs) b from m union select g a, f b from (select f, min(f) over (partition by canonical_ref) g from m where canonical_ref is not null)),
w as (select a, b from e union select b, a from e),
n as (select distinct unnest(refs) r from l),
c as (select r, r s from n union select w.b, c.s from c join w on w.a = c.r)
select r source_ref, min(s) group_ref from c group by 1""",
}
