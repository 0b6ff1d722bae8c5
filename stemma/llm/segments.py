"""The pigeonhole segment join: pairs of names within few edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most edits between two names, and the lengths of names by sound from which two and one are allowed.
EDITS, LONG, SHORT = 2, 8, 4


def edits_for(length: Column, short: int = SHORT, long: int = LONG) -> Column:
    """Edits allowed at a length: a name of `long` letters or more may differ by 2, of `short` or more by 1."""
    return F.when(length >= long, EDITS).when(length >= short, 1).otherwise(0)


def segment_join(names: DataFrame, keys: list[str], short: int = SHORT, long: int = LONG) -> DataFrame:
    """(keys..., a, b): all pairs a < b of distinct names with equal keys within the edits that the shorter one allows; exact.

    names has the keys and `name`. With k edits, one of k + 1 segments of the shorter name stays whole in the longer one,
    shifted by no more than the lengths and k permit; so only the substrings at those places are looked up in the inverted
    index of segments. Keys, lengths, number and text of a segment travel as one hash; a collision only brings a candidate
    more. Pairs are verified once by edit distance in a band of width k. Null names match nothing.
    """
    base = names.where("name is not null").select(*keys, "name").distinct().withColumn("n", F.length("name"))
    k = edits_for(F.col("n"), short, long)
    starts = F.expr("transform(sequence(0, k), i -> struct(cast(i as int) as i, cast(floor(i * n / (k + 1)) as int) as p, cast(floor((i + 1) * n / (k + 1)) - floor(i * n / (k + 1)) as int) as size))")
    slot = lambda i, segment: F.xxhash64(*keys, "l", i, segment).alias("slot")
    index = (
        base.withColumn("k", k)
        .where("n > k and k > 0")
        .withColumn("s", F.explode(starts))
        .withColumn("l", F.col("n"))
        .select(*keys, F.col("name").alias("short"), "k", slot(F.col("s.i"), F.expr("substring(name, s.p + 1, s.size)")))
    )
    # for each shorter length l and segment, the places where it can lie in this name
    probes = (
        base.withColumn("l", F.explode(F.expr(f"sequence(greatest(1, n - {EDITS}), n)")))
        .withColumn("k", edits_for(F.col("l"), short, long))
        .where("n - l <= k and l > k and k > 0")
        .withColumn("i", F.explode(F.expr("sequence(0, k)")))
        .withColumn("p", F.expr("cast(floor(i * l / (k + 1)) as int)"))
        .withColumn("size", F.expr("cast(floor((i + 1) * l / (k + 1)) as int) - p"))
        .withColumn("from", F.expr("greatest(0, p - cast(floor((k - (n - l)) / 2) as int))"))
        .withColumn("to", F.expr("least(n - size, p + cast(floor((k + (n - l)) / 2) as int))"))
        .where("from <= to")
        .withColumn("at", F.explode(F.expr("sequence(from, to)")))
        .select(*(F.col(c).alias(f"__{c}") for c in keys), F.col("name").alias("long"), slot(F.col("i"), F.expr("substring(name, at + 1, size)")))
    )
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    hits = probes.join(index, "slot").where(same & (F.col("short") != F.col("long")))
    pairs = hits.select(*keys, "k", F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")).distinct()
    return pairs.where(F.levenshtein("a", "b", EDITS).between(0, F.col("k"))).select(*keys, "a", "b")
