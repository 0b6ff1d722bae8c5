"""Mixing sources to target weights with hash thresholds found from histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.tokens import VOCABULARY, count_tokens
from stemma.tables import settle

#: Bits of the 32-bit hash that each histogram splits; three of them reach single hashes.
STEPS = (10, 10, 12)
#: Sources are counted on the driver; a mix has at most this many.
MAX_SOURCES = 10_000


def size_documents(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, h) of the documents of the sources in targets, written once; h is a 32-bit hash of doc_id."""
    named = docs.where(F.col("source").isNotNull()).join(targets.select("source").distinct(), "source", "left_semi")
    return settle(count_tokens(named.select("doc_id", "source", "text"), vocabulary=vocabulary).withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 32)))


def thresholds(sized: DataFrame, wanted: dict[str, int]) -> dict[str, int]:
    """For each source the t such that its documents with h < t come nearest to the wanted number of tokens.

    A first histogram sums tokens by source and the top bits of the hash. Each further one looks only into the bucket where
    the running sum of a source passes its budget. Buckets per source are fixed, so the driver gets sums only, never rows.
    """
    low = dict.fromkeys(wanted, 0)
    left = dict(wanted)
    width = 32
    for bits in STEPS:
        starts = sized.sparkSession.createDataFrame(list(low.items()), "source string, at long")
        span = 1 << width
        width -= bits
        sums: dict[str, list[tuple[int, int]]] = {}
        # one row per source, whose number was checked
        inside = sized.join(F.broadcast(starts), "source").where((F.col("h") >= F.col("at")) & (F.col("h") < F.col("at") + span))
        for r in inside.groupBy("source", F.shiftright(F.col("h") - F.col("at"), width).alias("b")).agg(F.sum("n_tokens").alias("t")).collect():
            sums.setdefault(r["source"], []).append((r["b"], r["t"]))
        for s in low:
            cut = 1 << bits
            for b, t in sorted(sums.get(s, [])):
                if t > left[s]:
                    # at a single hash, the side that is nearer to the budget
                    cut = b + (width == 0 and t - left[s] < left[s])
                    break
                left[s] -= t
            low[s] += cut << width
    return low


def plan_mix(sized: DataFrame, targets: DataFrame) -> list[tuple[str, float, int, int, int]]:
    """(source, share, copies, threshold, total tokens) per source: all documents are used `copies` times, those below the threshold once more.

    The mix is as large as the scarcest source allows at its most repeats. Weights count relative to the sources that have
    tokens; sources without any, without a positive weight or without a repeat are not used.
    """
    rows = targets.groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("m")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    have = {r["source"]: int(r["t"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect() if r["t"]}
    use = {r["source"]: (float(r["w"]), int(r["m"])) for r in rows if r["source"] in have and r["w"] and r["w"] > 0 and r["m"] and r["m"] > 0}
    if not use:
        return []
    weight = sum(w for w, _ in use.values())
    total = min(m * have[s] / (w / weight) for s, (w, m) in use.items())
    copies, part = {}, {}
    for s, (w, m) in use.items():
        budget = int(total * w / weight + 1e-6)
        copies[s] = min(m, budget // have[s])
        part[s] = budget - copies[s] * have[s] if copies[s] < m else 0
    cut = thresholds(sized, part)
    return [(s, use[s][0] / weight, copies[s], cut[s] if part[s] else 0, have[s]) for s in sorted(use)]


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, copies): every document of the mix and how often it is used.

    Which documents of a source are used once more than the others depends on a hash of doc_id alone: no sort, no
    shuffle of documents, and a smaller budget always takes a subset. Documents without a source, of other sources and
    unused ones are left out; documents without tokens are kept or not like any other.
    """
    sized = size_documents(docs, targets, vocabulary)
    plan = [(s, c, t) for s, _, c, t, _ in plan_mix(sized, targets)]
    # one row per source, whose number plan_mix has checked
    used = F.broadcast(docs.sparkSession.createDataFrame(plan, "source string, whole int, cut long"))
    copies = (F.col("whole") + (F.col("h") < F.col("cut")).cast("int")).cast("int")
    return sized.join(used, "source").select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_weight, max_repeats, documents, most_copies, tokens, actual_share) for every source in targets."""
    sums = mixed.groupBy("source").agg(
        F.count("*").alias("documents"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens")
    )
    total = sums.agg(F.sum("tokens").alias("total"))
    wanted = targets.groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    # total is one row
    joined = wanted.join(sums, "source", "left").join(F.broadcast(total), F.lit(True), "left").fillna(0, ["documents", "most_copies", "tokens"])
    return joined.select(
        "source", "target_weight", "max_repeats", "documents", "most_copies", "tokens", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share")
    )
