"""Filling containers of fixed capacity with documents by harmonic classes."""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.tokens import VOCABULARY, count_tokens

#: Documents that one worker packs at a time; the only bound on a task, and no document is left out by it.
SHARD_ROWS = 40_000
#: Most kinds of containers; more raise an error.
MAX_KINDS = 10_000
OUT = "container_kind string, container_id long, doc_id long, piece int, n_tokens long"


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The number of a bin for each length; no bin holds more than `capacity`, each length is at most that.

    Length l is of class j = capacity // l, so j of a class always fit. From the class of the longest on, each bin takes
    j documents of its class; its rest is topped up with the longest shorter-class documents that fit. Lengths of 0 go
    into the first bin.
    """
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order].tolist()
    n = len(size)
    bins = np.zeros(n, dtype=np.int64)
    if not n:
        return bins
    # size is descending; free[i] leads to the first place from i on that is not in a bin
    free = list(range(n + 1))

    def first(i: int) -> int:
        while free[i] != i:
            free[i] = free[free[i]]
            i = free[i]
        return i

    negated = [-s for s in size]
    number = -1
    i = first(0)
    while i < n and size[i] > 0:
        number += 1
        j, room = capacity // size[i], capacity
        for _ in range(j):
            if i >= n or size[i] == 0 or capacity // size[i] != j:
                break
            bins[order[i]] = number
            room -= size[i]
            free[i] = i + 1
            i = first(i)
        while room > 0:
            k = first(max(i, bisect.bisect_left(negated, -room)))
            if k >= n or size[k] == 0:
                break
            bins[order[k]] = number
            room -= size[k]
            free[k] = k + 1
        i = first(i)
    return bins


def pack_containers(docs: DataFrame, specs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, n_tokens): in which container of each kind every document lies.

    docs has doc_id and text. A document longer than the capacity is cut: each full piece has a container of its own and
    the remainder is packed as any other. Others stay whole, as piece 0. Empty and null texts have 0 tokens and lie in some
    container. Documents are dealt to workers by a hash of their id and packed there by `pack`, so equal or hot sources
    make no task larger. Kinds without a name or a positive capacity are left out; one with two
    capacities is an error.
    """
    caps = specs.where("container_kind is not null and capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    rows = caps.limit(MAX_KINDS + 1).collect()
    if len(rows) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    if len({r["container_kind"] for r in rows}) < len(rows):
        raise ValueError("a kind of container has two capacities")
    # ids only: reads one column, and its size decides how many shards there are
    shards = max(1, -(-docs.select("doc_id").count() // SHARD_ROWS))
    sized = count_tokens(docs.select("doc_id", "text"), vocabulary=vocabulary)
    # the list of kinds was counted above; every document goes to each kind
    items = sized.join(F.broadcast(caps), F.lit(True)).select("doc_id", "n_tokens", "container_kind", "capacity", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))

    def one(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        kind, c, shard = keys[0], int(keys[1]), keys[2]
        ids, sizes = part["doc_id"].to_numpy(), part["n_tokens"].to_numpy()
        by_id = np.lexsort((sizes, ids))  # the result does not depend on the order of arrival
        ids, sizes = ids[by_id], sizes[by_id]
        full = np.where(sizes > c, sizes // c, 0)
        rest = sizes - full * c
        whole = (rest > 0) | (sizes == 0)
        bins = pack(rest[whole], c)
        alone = np.repeat(np.arange(len(ids)), full)
        start = np.repeat(np.cumsum(full) - full, full)
        first_free = int(bins.max()) + 1 if len(bins) else 0
        out = pd.DataFrame({
            "doc_id": np.concatenate([ids[whole], ids[alone]]),
            "piece": np.concatenate([full[whole], np.arange(len(alone)) - start]).astype("int32"),
            "n_tokens": np.concatenate([rest[whole], np.full(len(alone), c)]),
            "container_id": (int(shard) << 32) + np.concatenate([bins, first_free + np.arange(len(alone))]),
        })
        out["container_kind"] = kind
        return out[["container_kind", "container_id", "doc_id", "piece", "n_tokens"]]

    run: Callable = one
    return items.groupBy("container_kind", "capacity", "shard").applyInPandas(run, OUT)


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(container_kind, containers, tokens, documents, fill): what each kind of container holds, and the part of it in use."""
    caps = specs.select("container_kind", "capacity_tokens").distinct()
    bins = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("t"), F.count(F.when(F.col("piece") == 0, 1)).alias("d"))
    return (
        bins.groupBy("container_kind")
        .agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.sum("d").alias("documents"), F.max("t").alias("fullest"))
        .join(caps, "container_kind")
        .select("container_kind", "containers", "tokens", "documents", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
    )
