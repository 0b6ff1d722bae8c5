"""Blocking: keys, their frequencies, the pairs they lead to, and what a duplicate search would cost."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """The bounds of a duplicate search."""

    bucket: int = 128
    pairs_per_person: int = 32
    scored: int = 50_000
    candidates: int = 50_000
    adjudications_per_person: int = 4
    adjudications: int = 250


def explode_keys(people: DataFrame, keys: Column, *keep: str) -> DataFrame:
    """(keep..., key): one row per person and distinct key; null keys are dropped."""
    return people.select(*keep, F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))


def key_frequencies(keyed: DataFrame) -> DataFrame:
    """(key, n): combined map-side, so a key that a third of the rows share is no hot spot."""
    return keyed.groupBy("key").agg(F.count("*").alias("n"))


def bounded_buckets(keyed: DataFrame, limit: int = Limits.bucket) -> DataFrame:
    """(key, n) of the keys that at least two and at most `limit` people have."""
    return key_frequencies(keyed).where((F.col("n") >= 2) & (F.col("n") <= limit))


def raw_pair_bound(keyed: DataFrame, source: str) -> DataFrame:
    """One row with raw_pairs: pairs across sources over all keys, by two levels of counting and no join."""
    per = keyed.groupBy("key", source).agg(F.count("*").alias("c"))
    both = per.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("within"))
    return both.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2 - F.col("within")), F.lit(0)).cast("long").alias("raw_pairs"))


def plan_estimate(people: DataFrame, keyed: DataFrame, source: str, limits: Limits = Limits()) -> DataFrame:
    """One row: people, sources, keys, eligible keys, the largest bucket, pairs by the keys and pairs after every cap."""
    counted = people.agg(F.count("*").alias("people"), F.countDistinct(source).alias("sources"))
    freq = key_frequencies(keyed)
    keys = freq.agg(
        F.count("*").alias("keys"), F.count(F.when(F.col("n").between(2, limits.bucket), 1)).alias("eligible_keys"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_bucket")
    )
    eligible = keyed.join(bounded_buckets(keyed, limits.bucket).select("key"), "key", "left_semi")
    # three tables of one row each
    joined = counted.join(F.broadcast(keys), F.lit(True)).join(F.broadcast(raw_pair_bound(eligible, source)), F.lit(True))
    most = F.least(F.col("raw_pairs"), F.floor(F.col("people") * limits.pairs_per_person / 2).cast("long"), F.lit(limits.scored).cast("long"))
    return joined.select("*", most.alias("scored_bound"), F.least(most, F.lit(limits.adjudications).cast("long")).alias("adjudication_bound"))


def owner_pairs(keyed: DataFrame, person: str, source: str | None = None, limit: int = Limits.bucket) -> DataFrame:
    """(l, r, key, n): each pair of people once, under the rarest eligible key both have, ties by key.

    Only keys of bounded buckets are joined, so no key makes more than limit^2 / 2 pairs; with `source`, only pairs across
    sources count.
    """
    rare = keyed.join(bounded_buckets(keyed, limit), "key")
    left = rare.select("key", "n", F.col(person).alias("l"), *([F.col(source).alias("ls")] if source else []))
    right = rare.select("key", F.col(person).alias("r"), *([F.col(source).alias("rs")] if source else []))
    pairs = left.join(right, "key").where(F.col("l") < F.col("r"))
    if source:
        pairs = pairs.where("ls != rs")
    return pairs.groupBy("l", "r").agg(F.min(F.struct("n", "key")).alias("o")).select("l", "r", "o.key", "o.n")


def capped_pairs(pairs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The pairs left by the greedy caps: rarest key first, at most so many pairs for a person on either end and in all.

    Each choice depends on those before it, so the sorted pairs pass through one task. It holds a counter per person and one
    batch; the sort spills to disk. Only this capped search does so; `owner_pairs` without caps has no such step.
    """
    ordered = pairs.orderBy("n", "key", "l", "r").coalesce(1)

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        total = 0
        for b in batches:
            keep = []
            for row, (x, y) in enumerate(zip(b["l"], b["r"], strict=True)):
                if total >= limits.scored:
                    break
                if seen.get(x, 0) < limits.pairs_per_person and seen.get(y, 0) < limits.pairs_per_person:
                    seen[x], seen[y] = seen.get(x, 0) + 1, seen.get(y, 0) + 1
                    total += 1
                    keep.append(row)
            yield b.iloc[keep]

    return ordered.mapInPandas(take, pairs.schema)


def top_candidates(scored: DataFrame, limit: int = Limits.candidates) -> DataFrame:
    """The `limit` best pairs by score, then by the smaller ids; each task keeps only its own best."""
    return scored.orderBy(F.desc("score"), "l", "r").limit(limit)
