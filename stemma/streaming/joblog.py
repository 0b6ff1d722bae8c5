"""A keyed event log as a stream: repeats of the last state are suppressed, nothing follows a terminal event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, sequence long, event_id long, state string"
STATE = "sequence long, state string, over boolean"


def log_events(events: DataFrame, terminal: tuple[str, ...]) -> DataFrame:
    """(key, sequence, event_id, state) of a stream (key, event_id, state).

    Per key the state store holds the last sequence, the last state and whether the log is over; that is all that grows, one
    small row per key. Events of one micro-batch are taken in the order of event_id.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sequence, last, over = state.get if state.exists else (0, None, False)
        out = []
        for b in [pd.concat(list(batches)).sort_values("event_id")]:
            for event_id, now in zip(b["event_id"], b["state"], strict=True):
                if over or now == last:
                    continue
                sequence, last, over = sequence + 1, now, now in terminal
                out.append((key[0], sequence, event_id, now))
        state.update((sequence, last, over))
        yield pd.DataFrame(out, columns=["key", "sequence", "event_id", "state"])

    return events.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(log: DataFrame, after: int) -> DataFrame:
    """Events beyond a cursor; a cursor before what is kept, or after the end, is an error."""
    r = log.agg(F.min("sequence").alias("least"), F.max("sequence").alias("most")).first()
    if r["least"] is not None and not r["least"] - 1 <= after <= r["most"]:
        raise ValueError(f"the cursor {after} has expired")
    return log.where(F.col("sequence") > after)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total): counts of tumbling or sliding windows, with late events dropped beyond the watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, user_id, n): events by session of a user, a session ending after the gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def _generations(spark, state_path: str) -> list[int]:  # noqa: ANN001
    path = spark._jvm.org.apache.hadoop.fs.Path(state_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = (s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else ()
    return sorted(int(n.removeprefix("generation=")) for n in names if n.startswith("generation="))


def apply_snapshots(batches: DataFrame, state_path: str, checkpoint: str, tombstones: DataFrame | None = None):  # noqa: ANN201
    """Writes each micro-batch of (person, hash, generation) as a state of its own, united with the newest state before it.

    The state is that of relations.carry_blocks. A batch that is run again after a failure starts from the same state and overwrites
    its own folder only, so the result is the same. Tombstones (hash) keep blocks from coming back.
    """
    from stemma.operators.relations import carry_blocks, observed

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        none = spark.createDataFrame([], "hash string")
        new = observed(batch)
        before = [g for g in _generations(spark, state_path) if g < number]
        old = spark.read.parquet(f"{state_path}/generation={before[-1]}") if before else new.limit(0)
        carry_blocks(old, new, none if tombstones is None else tombstones).write.mode("overwrite").parquet(f"{state_path}/generation={number}")

    return batches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
