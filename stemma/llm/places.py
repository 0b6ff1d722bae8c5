"""Mapping places as typed to a reference list by a prefix-filtered set-similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.placetext import PlaceReader, bigrams, fold_name
from stemma.tables import settle

READ = T.StructType([
    T.StructField("value", T.StringType()), T.StructField("n", T.LongType()), T.StructField("levels", T.IntegerType()), T.StructField("towns", T.ArrayType(T.StringType())),
    T.StructField("county", T.StringType()), T.StructField("country", T.StringType()), T.StructField("off_map", T.BooleanType()),
])
#: The reference list goes to every task; it is read only up to this many rows.
MAX_REFERENCE = 100_000


def reader_for(places: DataFrame) -> PlaceReader:
    """A reader that knows the counties and countries of the reference list, whose size is checked, and the main names of its towns."""
    rows = places.select("name", "country", "alternate_names").limit(MAX_REFERENCE + 1).collect()
    if len(rows) > MAX_REFERENCE:
        raise ValueError(f"the reference list has more than {MAX_REFERENCE} rows")
    aliases = {fold_name(a): fold_name(r["name"].split(",")[0]) for r in rows if r["name"] for a in r["alternate_names"] or () if a}
    countries = sorted({c.strip() for r in rows for c in ((r["country"] or ""), *((r["name"] or "").split(",")[2:3])) if c.strip()})
    return PlaceReader(sorted({p[1].strip() for r in rows if r["name"] and len(p := r["name"].split(",")) > 1 and p[1].strip()}), aliases, countries)


def read_places(values: DataFrame, reader: PlaceReader) -> DataFrame:
    """(value, n, levels, towns, county, country, off_map) for a DataFrame (value, n) of distinct texts and their numbers of rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([reader.read(x) for x in b["value"]], columns=["levels", "towns", "county", "country", "off_map"])
            yield pd.concat([b[["value", "n"]].reset_index(drop=True), out], axis=1)

    return values.mapInPandas(read, READ)


@F.pandas_udf(T.ArrayType(T.StringType()))
def bigram_set(names: pd.Series) -> pd.Series:
    return names.map(bigrams)


@F.pandas_udf(T.StringType())
def folded(names: pd.Series) -> pd.Series:
    return names.map(lambda s: fold_name(s) if s is not None else "")


@F.pandas_udf(T.StringType())
def county_core(names: pd.Series) -> pd.Series:
    return names.map(PlaceReader.core)


def _by_rarity(sets: DataFrame, key: str, ranks: DataFrame) -> DataFrame:
    """Adds `tokens`, each name's tokens from globally rarest to most frequent."""
    return (
        sets.select(key, F.explode("grams").alias("g"))
        .join(ranks, "g")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("rank")).alias("tokens"))
    )


def similarity_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_name, right_name, jaccard) of all pairs of distinct names whose token sets reach the threshold; exact.

    left and right have the columns name and grams (a set of tokens). Tokens are ordered by rarity over both sides;
    two sets with Jaccard t or more share a token within the first n - ceil(t n) + 1 of each, so only those are joined.
    Length and position bounds drop hopeless pairs inside the join; the rest are verified on the whole sets.
    Names without tokens match nothing.
    """
    counts = left.select("grams").unionAll(right.select("grams")).select(F.explode("grams").alias("g")).groupBy("g").count()
    # the number of distinct letter pairs is bounded by the alphabet, not by the rows
    ranks = counts.select("g", F.struct("count", "g").alias("rank"))

    def prefixed(df: DataFrame, side: str) -> DataFrame:
        n = F.size("tokens")
        keep = n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + 1
        return _by_rarity(df, "name", ranks).select(
            F.col("name").alias(f"{side}_name"), n.alias(f"{side}_n"), F.transform("tokens", lambda t: t["g"]).alias(f"{side}_tokens"),
            F.posexplode(F.slice(F.transform("tokens", lambda t: t["g"]), F.lit(1), keep.cast("int"))).alias(f"{side}_pos", "g"),
        )

    a, b = prefixed(left, "left"), prefixed(right, "right")
    rest = F.least(F.col("left_n") - F.col("left_pos"), F.col("right_n") - F.col("right_pos"))
    need = F.lit(threshold / (1 + threshold)) * (F.col("left_n") + F.col("right_n"))
    hits = a.join(b, "g").where(
        (F.col("left_n") >= F.col("right_n") * threshold) & (F.col("right_n") >= F.col("left_n") * threshold)
        & (rest + 1e-9 >= need)  # holds at the rarest common token, where alone a pair is verified
    )
    # one pass over both sets a pair; explode keeps the optimizer from repeating it
    met = F.transform(F.array(F.array_intersect("left_tokens", "right_tokens")), lambda common: F.when(F.element_at(common, 1) == F.col("g"), F.size(common)))
    both = hits.select("left_name", "right_name", "left_n", "right_n", F.explode(met).alias("both")).where("both is not null")
    return (
        both.withColumn("jaccard", F.col("both") / (F.col("left_n") + F.col("right_n") - F.col("both")))
        .where(F.col("jaccard") >= threshold - 1e-9)
        .select("left_name", "right_name", "jaccard")
    )


def reference_names(places: DataFrame) -> DataFrame:
    """(name, placeid, county, country, main): every name of each listed town, folded, with the core of its county."""
    parts = F.split("name", ",")
    county = folded(F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))))
    named = places.where(F.col("placeid").isNotNull() & F.col("name").isNotNull()).select(
        "placeid", county_core(county).alias("county"), folded(F.lower(F.coalesce("country", F.get(parts, F.lit(2))))).alias("country"),
        F.posexplode(F.concat(F.array(F.get(parts, F.lit(0))), F.coalesce("alternate_names", F.array().cast("array<string>")))).alias("i", "town"),
    )
    return named.select(folded("town").alias("name"), "placeid", "county", "country", (F.col("i") == 0).alias("main")).where("name != ''")


def match_places(values: DataFrame, places: DataFrame, threshold: float = 0.4, sure: float = 0.6) -> DataFrame:
    """(value, placeid, jaccard): the listed place that each distinct text means, 0 if none.

    values has one column of distinct texts with their numbers of rows: (value, n). Readings with the same town, county
    and country are matched once. A pair counts from `sure` on, between `threshold` and `sure` only if an exact check finds few edits: 2, 1 in names
    of less than 7 letters, 3 with the right county. Below `threshold` a pair counts only with the right county and at most 3 edits,
    in names of less than 7 letters one for three letters.
    A stated county or country that contradicts a place rules it out. Among equals, the place that more rows name
    together with its county wins, then the smaller placeid. Blank texts and those that state no place give 0.
    """
    read = settle(read_places(values, reader_for(places)))
    towns = read.select("value", "n", "county", "country", F.explode("towns").alias("town"))
    readings = towns.groupBy("town", "county", "country").agg(F.sum("n").alias("n"))
    refs = reference_names(places)
    left = readings.select(F.col("town").alias("name")).distinct().withColumn("grams", bigram_set("name"))
    right = refs.select("name").distinct().withColumn("grams", bigram_set("name"))
    pairs = similarity_join(left, right, threshold)
    r = refs.select(F.col("name").alias("right_name"), "placeid", F.col("county").alias("ref_county"), F.col("country").alias("ref_country"))
    edits = F.levenshtein("town", "right_name")
    same_county = F.col("county") == F.col("ref_county")
    # few edits can leave few letter pairs; towns of a stated county meet all listed towns of that county
    slips = F.when(F.length("town") >= 7, 3).otherwise(F.floor(F.length("town") / 3))
    local = readings.where("county != ''").select("town", "county").distinct().join(r, same_county).where((F.abs(F.length("town") - F.length("right_name")) <= 3) & (edits <= slips))
    local = local.select(F.col("town").alias("left_name"), "right_name").distinct().join(left.select(F.col("name").alias("left_name"), F.col("grams").alias("x")), "left_name").join(right.select(F.col("name").alias("right_name"), F.col("grams").alias("y")), "right_name")
    both = F.size(F.array_intersect("x", "y"))
    local = local.select("left_name", "right_name", (both / (F.size("x") + F.size("y") - both)).alias("jaccard")).where(F.col("jaccard") < threshold - 1e-9)
    pairs = pairs.unionByName(local)
    # used twice
    found = settle(
        readings.join(pairs, F.col("town") == F.col("left_name"))
        .join(r, "right_name")
        .where((F.col("county") == "") | same_county)
        .where((F.col("country") == "") | F.array_contains(F.split("country", r"\|"), F.col("ref_country")))
        .where((F.col("jaccard") >= threshold - 1e-9) | same_county)
        .where((F.col("jaccard") >= sure) | (edits <= F.when(same_county, 3).when(F.length("town") < 7, 1).otherwise(2)))
        .groupBy("town", "county", "country", "n", "placeid")
        .agg(F.max("jaccard").alias("jaccard"), F.max(same_county.cast("int")).alias("told"))
    )
    sure_rows = found.where("told = 1 and jaccard >= 0.999").groupBy("placeid").agg(F.sum("n").alias("weight"))
    w = Window.partitionBy("town", "county", "country").orderBy(F.desc("jaccard"), F.desc("weight"), "placeid")
    best = found.join(sure_rows, "placeid", "left").fillna(0, ["weight"]).withColumn("k", F.row_number().over(w)).where("k = 1")
    chosen = (
        towns.join(best.select("town", "county", "country", "placeid", "jaccard"), ["town", "county", "country"])
        .groupBy("value")
        .agg(F.max_by("placeid", F.struct("jaccard", -F.col("placeid"))).alias("placeid"), F.max("jaccard").alias("jaccard"))
    )
    return read.select("value").join(chosen, "value", "left").select("value", F.coalesce("placeid", F.lit(0)).cast("long").alias("placeid"), "jaccard")


def map_places(rows: DataFrame, places: DataFrame, column: str = "birth_place") -> DataFrame:
    """Adds placeid to each row whose place is not null, empty or blank. Equal texts are matched once.

    A text that a large part of the rows share is counted map-side, matched once and joined back; as the mapping has one
    row per text, skewed texts are split by AQE on the side of the rows.
    """
    stated = rows.where(F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"\s+", " ")) != "")
    values = stated.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return stated.join(match_places(values, places).withColumnRenamed("value", column), column)
