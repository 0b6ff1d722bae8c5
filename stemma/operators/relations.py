"""Joins, set differences and window logic of the engine, over any tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.tables import settle


def missing(refs: DataFrame, declared: DataFrame, on: list[str]) -> DataFrame:
    """Rows of refs without a partner in declared; null keys never have one."""
    return refs.join(declared.select(*on).distinct(), on, "left_anti")


def one_sided(edges: DataFrame, back: DataFrame, on: list[str], exists: DataFrame, key: str) -> DataFrame:
    """Edges that the other side does not return, although its record exists."""
    return missing(edges.join(exists.select(key).distinct(), key, "left_semi"), back, on)


def range_violations(parents: DataFrame, children: DataFrame, key: str, low: Column, high: Column) -> DataFrame:
    """Pairs joined by key whose measure lies outside [low, high]; the range is a residual of the equi-join."""
    return parents.join(children, key).where(low | high)


def owner_first(rows: DataFrame, first: DataFrame, second: DataFrame, first_key: str, second_key: str) -> DataFrame:
    """Adds owner_kind and owner_id: the first owner wins over the second; rows with neither have null."""
    a = first.select(F.col(first_key).alias("__a")).distinct()
    b = second.select(F.col(second_key).alias("__b")).distinct()
    out = rows.join(a, F.col(first_key) == F.col("__a"), "left").join(b, F.col(second_key) == F.col("__b"), "left")
    kind = F.when(F.col("__a").isNotNull(), "first").when(F.col("__b").isNotNull(), "second")
    return out.select(*rows.columns, kind.alias("owner_kind"), F.coalesce("__a", "__b").alias("owner_id"))


def safe_only(items: DataFrame, uses: DataFrame, key: str, safe: Column) -> DataFrame:
    """Items that some safe use names and no unsafe one."""
    return items.join(uses.where(safe).select(key).distinct(), key, "left_semi").join(uses.where(~safe).select(key).distinct(), key, "left_anti")


def unpivot_rest(rows: DataFrame, key: str, known: list[str]) -> DataFrame:
    """(key, field, value): the filled columns that no one mapped, as text."""
    rest = sorted((c for c in rows.columns if c != key and c not in known), key=str.lower)
    values = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in rest))
    return rows.select(key, F.explode(values).alias("v")).select(key, "v.field", "v.value").where("value is not null and trim(value) != ''")


def first_filled(*columns: str) -> Column:
    """The first of the columns that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in columns))


def semantic_key(col: Column) -> Column:
    """Sorts null before numbers before text: struct(class, number, text); text that is an integer counts as a number."""
    text = col.cast("string")
    number = F.when(text.rlike(r"^[+-]?\d{1,37}$"), text.cast("decimal(38,0)"))
    rank = F.when(col.isNull(), 0).when(number.isNotNull(), 1).otherwise(2)
    return F.struct(rank.alias("rank"), number.alias("number"), F.when(rank == 2, F.lower(text)).alias("text"))


def ranked(rows: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """Adds the place of each row in a total order, from 1 on, without gathering the rows in one task.

    Rows are sorted by range partitions and written once; the numbers of rows before each partition, one number per
    partition, are added to the places inside it.
    """
    part = settle(rows.withColumn("__key", F.struct(*(c if not isinstance(c, str) else F.col(c) for c in order))).repartitionByRange("__key").withColumn("__part", F.spark_partition_id()))
    counts = part.groupBy("__part").agg(F.count("*").alias("n"), F.min("__key").alias("least"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "before")
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__key"))
    # one row per partition
    return part.withColumn("__place", place).join(F.broadcast(before), "__part").withColumn(out, F.col("__place") + F.col("before")).drop("__key", "__part", "__place", "before")


def keep_last(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The newest n rows of each key; tasks drop all but their own n before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def slices_diff(old: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(added, removed) keys between two sets, by anti-joins both ways."""
    return missing(new.select(*key).distinct(), old, key), missing(old.select(*key).distinct(), new, key)


def carry_blocks(state: DataFrame, incoming: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(person, hash, first_generation, last_generation, observations): the state after a snapshot, both with these columns.

    Incoming blocks with a tombstone on their hash are dropped, those of the state stay. Blocks of both keep their first
    generation and add up their observations.
    """
    alive = incoming.join(tombstones.select("hash").distinct(), "hash", "left_anti")
    columns = ["person", "hash", "first_generation", "last_generation", "observations"]
    both = state.select(*columns).unionByName(alive.select(*columns)).groupBy("person", "hash")
    return both.agg(F.min("first_generation").alias("first_generation"), F.max("last_generation").alias("last_generation"), F.sum("observations").alias("observations"))


def observed(blocks: DataFrame) -> DataFrame:
    """Blocks (person, hash, generation) in the form of a state."""
    g = F.col("generation")
    return blocks.groupBy("person", "hash").agg(F.min(g).alias("first_generation"), F.max(g).alias("last_generation"), F.count("*").alias("observations"))


def reconcile_blocks(state: DataFrame, incoming: DataFrame, tombstones: DataFrame) -> DataFrame:
    """As carry_blocks, of blocks (person, hash, generation)."""
    return carry_blocks(observed(state), observed(incoming), tombstones)


def running(rows: DataFrame, order: list[str], flag: Column, out: str) -> DataFrame:
    """Adds the running sum of a number over a total order of all rows, without gathering them in one task."""
    part = settle(rows.withColumn("__flag", flag.cast("long")).withColumn("__key", F.struct(*order)).repartitionByRange("__key").withColumn("__part", F.spark_partition_id()))
    sums = part.groupBy("__part").agg(F.sum("__flag").alias("n"), F.min("__key").alias("least"))
    before = sums.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    inside = F.sum("__flag").over(Window.partitionBy("__part").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0))
    # one row per partition
    return part.withColumn("__sum", inside).join(F.broadcast(before), "__part").withColumn(out, F.col("__sum") + F.col("__before")).drop("__flag", "__key", "__part", "__sum", "__before")


def latest_versions(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key; of equal ones any. Tasks keep their own best before the shuffle."""
    return rows.where(F.col(version).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), version).alias("__r")).select(key, "__r.*").select(*rows.columns)


def next_number(rows: DataFrame, key: str, number: str, out: str) -> DataFrame:
    """(key, out): the number after the highest of each key."""
    return rows.groupBy(key).agg((F.max(number) + 1).alias(out))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group in the order; tasks drop all but their own first before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def multiplicity(rows: DataFrame, keys: list[str], origin: str, out: str = "n") -> DataFrame:
    """(keys, out): the largest number of times that one origin has each key."""
    return rows.groupBy(*keys, origin).agg(F.count("*").alias("__c")).groupBy(*keys).agg(F.max("__c").alias(out))


def alternatives(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, alternatives): keys under which more than one filled value stands, with their number."""
    return rows.where(F.trim(value) != "").groupBy(key).agg(F.countDistinct(value).alias("alternatives")).where("alternatives > 1")


def inconsistent(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): groups whose rows do not all have one value, with the number of their values."""
    return rows.groupBy(*keys).agg(F.countDistinct(value).alias(out)).where(F.col(out) > 1)


def multimap(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the different values of each key, in order."""
    return rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value).distinct().groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def losses(counted: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(table_name, n_rows, lost): how many rows of each table have no part in what was written; only tables that lose any.

    counted has a name, the table and what was written of it.
    """
    out = None
    for name, rows, written in counted:
        a, b = rows.agg(F.count("*").alias("n_rows")), written.agg(F.count("*").alias("kept"))
        one = a.join(F.broadcast(b), F.lit(True)).select(F.lit(name).alias("table_name"), "n_rows", (F.col("n_rows") - F.col("kept")).alias("lost")).where("lost > 0")
        out = one if out is None else out.unionByName(one)
    return out


def group_refs(rows: DataFrame, key: str, refs: str) -> DataFrame:
    """(key, refs, n_refs): the different refs of all rows of a key, in order, as one text. Refs are made one before they meet."""
    return rows.select(key, F.explode(refs).alias("r")).where("r is not null").distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("r")), ",").alias("refs"), F.count("*").alias("n_refs"))


def text_groups(rows: DataFrame, text: str, key: str) -> DataFrame:
    """(text_key, n, first): texts that more than one row has, by their hash; counts are combined before the shuffle."""
    return rows.where(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256).alias("text_key")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def interrupted(log: DataFrame, key: str, active: list[str]) -> DataFrame:
    """(key, sequence, state, error): what a restart adds to a log (key, sequence, state): a failure after each job whose last event is an active state."""
    last = log.groupBy(key).agg(F.max(F.struct("sequence", "state")).alias("last"))
    return last.where(F.col("last.state").isin(*active)).select(key, (F.col("last.sequence") + 1).alias("sequence"), F.lit("failed").alias("state"), F.lit("JOB_INTERRUPTED").alias("error"))


def event_log(events: DataFrame, key: str, order: list[str], payload: list[str], terminal: Column) -> DataFrame:
    """(key, sequence, order..., payload...): the log of each key without repeats of the state before and without anything after a terminal event."""
    w = Window.partitionBy(key).orderBy(*order)
    state = F.struct(*payload)
    ended = F.max(terminal.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = events.withColumn("__same", F.coalesce(F.lag(state).over(w) == state, F.lit(False))).withColumn("__over", F.coalesce(ended, F.lit(0)) > 0)
    kept = kept.where("not __same and not __over")
    return kept.select(key, F.row_number().over(w).alias("sequence"), *order, *payload)
