"""Matching persons across sources without keys: a two-component Gaussian mixture over similarity vectors, fitted without labels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt, prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.functions.dates import with_dates
from stemma.llm.aliases import abbreviates, given_classes, is_short, with_roots
from stemma.llm.names import read_name
from stemma.llm.placetext import PlaceReader
from stemma.llm.places import reader_for
from stemma.tables import drop_settled, settle

#: Similarities and the number of steps each is rounded to; their product bounds what the driver gets.
GRID = {"surname": 10, "first": 10, "middle": 4, "date": 10, "place": 10}
ROUNDS, OUTER, RIDGE, SURE = 60, 20, 0.004, 0.5
#: EM under transitivity ends when no posterior moves by as much, at the latest after OUTER rounds.
SETTLED = 0.01
#: A block of more than so many pairs is hot: its pairs of equal further parts come first, the others in chunks of so many pairs.
BLOCK_PAIRS = 200_000
#: Rows of a side that a join holds in hash tables, at most so many a shuffle partition; pairs that are broadcast, at most.
HASHED, FEW = 100_000, 10_000
PARTS = T.StructType([
    T.StructField("side", T.IntegerType()), T.StructField("id", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("surname", "first", "middle", "suffix")), T.StructField("others", T.ArrayType(T.StringType())),
    T.StructField("birth_place", T.StringType()), T.StructField("birth_date", T.StringType()),
])


def read_names(persons: DataFrame) -> DataFrame:
    """(side, id, surname, first, middle, suffix, others, birth_place, birth_date): the parts of each person's names as typed.

    others holds the surnames of the alternate names. Parts that are not stated are empty.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [read_name(n) for n in b["full_name"].to_numpy(zero_copy_only=False)]
            others: list[list[str]] = [[]] * len(own)
            more = b["alternate_names"]
            # most have no other name
            for i in np.flatnonzero(more.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist():
                others[i] = sorted({s for x in more[i].as_py() if (s := read_name(x)[0]) and s != own[i][0]})
            parts = [pa.array(column, pa.string()) for column in (zip(*own, strict=True) if own else ((),) * 4)]
            yield pa.RecordBatch.from_arrays([b["side"], b["id"], *parts, pa.array(others, pa.list_(pa.string())), b["birth_place"], b["birth_date"]], PARTS.names)

    typed = [F.col("side"), F.col("id").cast("long").alias("id"), "full_name", "alternate_names", "birth_place", "birth_date"]
    return persons.select(*typed).mapInArrow(read, PARTS)


def by_hash(df: DataFrame) -> DataFrame:
    """df, which is settled and has one row a key, as the side of a join that is held in hash tables, so that neither side is sorted.

    It is left to Spark where a task might hold too many rows.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.hint("shuffle_hash") if df.count() <= HASHED * tasks else df


def read_towns(values: DataFrame, reader: PlaceReader) -> DataFrame:
    """(birth_place, town, county, country) for distinct texts; a town under another of its names counts as its main one."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for place in b["birth_place"]:
                _, towns, county, country, _ = reader.read(place)
                out.append((place, reader.aliases.get(towns[0], towns[0]) if towns else "", county, country))
            yield pd.DataFrame(out, columns=["birth_place", "town", "county", "country"])

    return values.mapInPandas(read, "birth_place string, town string, county string, country string")


def read_sources(persons: list[DataFrame], reader: PlaceReader, evidence: DataFrame | None = None) -> DataFrame:
    """(side, id, surname, first, middle, suffix, others, town, county, country, d): the comparable parts of the persons of all sources; side is the place of the source.

    Each source has id, full_name, alternate_names, birth_date and birth_place. Given names are replaced by their roots, which
    are learned from the alternate names of all sources and of evidence; equal places of all sources are read once.
    """
    union = lambda parts: reduce(DataFrame.unionAll, parts)
    columns = ["id", "full_name", "alternate_names", "birth_place", "birth_date"]
    read = settle(read_names(union(p.select(F.lit(i).alias("side"), *columns) for i, p in enumerate(persons))))
    towns = settle(read_towns(read.select("birth_place").where(F.trim("birth_place") != "").distinct(), reader))
    classes = given_classes(read.select("first", "middle"), union(p.select("full_name", "alternate_names") for p in [*persons, *([] if evidence is None else [evidence])]))
    # equal dates, too; those without one share the empty text
    read_date = F.coalesce("birth_date", F.lit("")).alias("__date")
    d = settle(with_dates(read.select(read_date).distinct(), {"__date": "d"}))
    placed = with_roots(read, classes, ["first", "middle"]).join(by_hash(towns), "birth_place", "left").drop("birth_place").fillna("", ["town", "county", "country"])
    return placed.withColumn("__date", read_date).join(by_hash(d), "__date").drop("__date", "birth_date")


def read_persons(persons: list[DataFrame], reader: PlaceReader, evidence: DataFrame | None = None) -> list[DataFrame]:
    """What read_sources says of each source."""
    read = settle(read_sources(persons, reader, evidence))
    return [read.where(F.col("side") == i).drop("side") for i in range(len(persons))]


def collapse(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct persons with `rep`, (rep, id)): rows that compare alike are matched once, however many there are."""
    what = [c for c in read.columns if c != "id"]
    marked = read.withColumn("rep", F.xxhash64(*what))
    return marked.drop("id").dropDuplicates(["rep"]), marked.select("rep", "id")


def _skeleton(surname: Column) -> Column:
    """The first letter and the consonants of a name by sound, at most six."""
    return F.substring(F.concat(F.substring(surname, 1, 1), F.translate(F.substring(surname, 2, 99), "aeiouh", "")), 1, 6)


def finer_part(p: DataFrame) -> DataFrame:
    """(rep, finer), hashed: further parts of each person, by which hot blocks are cut."""
    return p.select("rep", F.xxhash64("first", F.substring("surname", 1, 3), "d.y", F.substring("town", 1, 4)).alias("finer"))


def block_keys(p: DataFrame, *keep: str) -> DataFrame:
    """(rep, key), hashed: the blocks of each person: by date, by surname and initial, by given name, town and year.

    Two keys of one hash only bring more pairs. Keys are hashed part by part, as no text is needed; lambdas, which run
    uncompiled, are left to the few who have other surnames.
    """
    initial, whole = F.substring("first", 1, 1), ~is_short(F.col("first")) & (F.col("first") != "")
    key = lambda kind, *parts: F.xxhash64(F.lit(kind), *parts)
    day = F.when(F.col("d.d").isNotNull(), key("d", "d.y", "d.m", "d.d"))
    month = F.when(F.col("d.m").isNotNull() & (initial != ""), key("m", "d.y", "d.m", initial, F.substring("town", 1, 3)))
    name = F.when(F.col("surname") != "", key("n", _skeleton(F.col("surname")), initial))
    names = F.transform(F.filter("others", lambda s: s != ""), lambda s: key("n", _skeleton(s), initial))
    others = F.when(F.size("others") > 0, F.array_except(names, F.array(name))).otherwise(F.array().cast("array<bigint>"))
    lived = F.when(whole & (F.col("town") != "") & F.col("d.y").isNotNull(), key("t", "first", F.substring("town", 1, 5), "d.y"))
    tail = F.when((F.length("surname") > 4) & F.col("d.y").isNotNull(), key("y", F.expr("right(surname, 4)"), F.substring("surname", 1, 2), initial, "d.y"))
    # halves of the surname with the town, for slips in the other half and dates that are missing
    home = (F.length("surname") > 4) & (initial != "") & (F.col("town") != "")
    head = F.when(home, key("h", F.substring("surname", 1, 4), initial, F.substring("town", 1, 4)))
    foot = F.when(home, key("f", F.expr("right(surname, 4)"), "first", F.expr("right(town, 5)"), F.substring("town", 1, 1)))
    front = F.when((F.length("surname") > 4) & whole, key("s", F.substring("surname", 1, 5), "first"))
    keys = F.concat(F.array(day, month, lived, tail, head, foot, front, name), others)
    return p.select(*keep, "rep", F.explode(keys).alias("key")).where("key is not null")


def hot_blocks(keys: DataFrame) -> DataFrame:
    """(key, na, nb) of the blocks with more than BLOCK_PAIRS pairs, from (side, rep, key)."""
    n = keys.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb"))
    return settle(n.where(F.col("na") * F.col("nb") > BLOCK_PAIRS))


def blocks(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keys of either side, as of block_keys, and the hot blocks."""
    keys = settle(block_keys(a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1))), "side"))
    ka, kb = (keys.where(F.col("side") == i).drop("side") for i in (0, 1))
    return ka, kb, hot_blocks(keys)


def candidates(a: DataFrame, b: DataFrame, found: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(l, r): pairs of persons that share a block, in a hot one with equal name, year and town; hot_rest has its other pairs."""
    ka, kb, hot = found or blocks(a, b)
    if hot.isEmpty():
        return ka.withColumnRenamed("rep", "l").join(kb.withColumnRenamed("rep", "r"), "key").select("l", "r").repartition("l").distinct()

    def cut(p: DataFrame, k: DataFrame) -> DataFrame:
        marked = k.join(hot.select("key", F.lit(True).alias("hot")), "key", "left").join(finer_part(p), "rep")
        return marked.select("rep", "key", F.when(F.col("hot"), F.col("finer")).otherwise(F.lit(0)).alias("sub"))

    left, right = cut(a, ka).withColumnRenamed("rep", "l"), cut(b, kb).withColumnRenamed("rep", "r")
    # dealt by l, so that persons are joined to the pairs where they lie
    return left.join(right, ["key", "sub"]).select("l", "r").repartition("l").distinct()


def hot_rest(a: DataFrame, b: DataFrame, found: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame | None:
    """As compared: all pairs of the hot blocks that candidates leaves out, each once; None without a hot block.

    Both sides of a block are dealt into chunks, and each chunk meets each of the other side, so that no group of the join
    has many more than BLOCK_PAIRS pairs and no pair is lost. Persons travel with their chunk: pairs are compared as they arise.
    """
    ka, kb, hot = found
    total = hot.agg(F.sum(F.col("na") * F.col("nb"))).first()[0]
    if not total:
        return None
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, total // (10 * BLOCK_PAIRS)))
    width = max(1, isqrt(BLOCK_PAIRS))

    def dealt(p: DataFrame, k: DataFrame, rep: str, own: str, other: str, person: str) -> DataFrame:
        marked = k.join(hot.select("key", F.lit(True).alias("hot")), "key", "left").join(finer_part(p), "rep")
        held = marked.groupBy("rep", "finer").agg(F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hots"), F.collect_set(F.when(F.col("hot").isNull(), F.col("key"))).alias("colds")).where(F.size("hots") > 0)
        whole = p.select("rep", F.struct(*(c for c in p.columns if c != "rep")).alias("who"))
        chunks = lambda side: F.ceil(F.col(f"n{side}") / width)
        rows = held.join(whole, "rep").withColumn("key", F.explode("hots")).join(hot, "key")
        rows = rows.select(
            "key", F.pmod("rep", chunks(own)).alias(f"c{own}"), F.explode(F.sequence(F.lit(0).cast("long"), chunks(other) - 1)).alias(f"c{other}"), F.col("rep").alias(rep),
            F.struct("finer", "hots", "colds").alias(f"{person}_at"), F.col("who").alias(person),
        )
        return rows.repartition(parts, "key", "ca", "cb")

    x, y = dealt(a, ka, "l", "a", "b", "x"), dealt(b, kb, "r", "b", "a", "y")
    met = x.hint("merge").join(y, ["key", "ca", "cb"])
    # a pair belongs to the least of the hot blocks that it shares
    own = (F.col("x_at.finer") != F.col("y_at.finer")) & ~F.arrays_overlap("x_at.colds", "y_at.colds") & (F.col("key") == F.array_min(F.array_intersect("x_at.hots", "y_at.hots")))
    return _on_grid(met.where(own))


def _ratio(x: Column, y: Column) -> Column:
    return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))


def _vector(x: str, y: str) -> dict[str, Column]:
    """The similarities of persons x and y (struct columns), each from 0 to 1; 0.5 where one side states nothing."""
    a, b = F.col(x), F.col(y)
    own = _ratio(a["surname"], b["surname"])
    over = lambda arr, s: F.coalesce(F.array_max(F.transform(arr, lambda o: _ratio(o, s))), F.lit(0.0))
    surname = F.when((a["surname"] == "") | (b["surname"] == ""), 0.5).otherwise(F.greatest(own, over(a["others"], b["surname"]), over(b["others"], a["surname"]), F.when(F.arrays_overlap(a["others"], b["others"]), 1.0).otherwise(0.0)))

    def names(p: Column, q: Column) -> Column:
        short = (is_short(p) & abbreviates(p, q)) | (is_short(q) & abbreviates(q, p))
        return F.when(p == q, 1.0).when(short, 0.9).otherwise(_ratio(p, q) * 0.7)

    first = F.when((a["first"] == "") | (b["first"] == ""), 0.5).otherwise(names(a["first"], b["first"]))
    middle = F.when((a["middle"] == "") | (b["middle"] == ""), 0.75).otherwise(F.when(names(a["middle"], b["middle"]) >= 0.9, 1.0).otherwise(0.0))
    middle = F.when(a["suffix"] != b["suffix"], F.least(middle, F.lit(0.25))).otherwise(middle)
    p, q = a["d"], b["d"]
    exact = F.least(p["precision"], q["precision"])
    gap = F.greatest(p["lo"] - q["hi"], q["lo"] - p["hi"])
    same_y, same_m, same_d = p["y"] == q["y"], p["m"] == q["m"], p["d"] == q["d"]
    slip = (same_m & same_d & (F.abs(p["y"] - q["y"]) <= 1)) | (same_y & same_m & (F.abs(p["d"] - q["d"]) <= 1)) | (same_y & (p["d"] == q["m"]) & (p["m"] == q["d"]))
    date = (
        F.when(exact == 0, 0.5)
        .when((exact == 4) & same_y & same_m & same_d, 1.0)
        .when((exact == 4) & slip, 0.7)
        .when((exact == 4) & same_y & (same_m | same_d), 0.4)
        .when(exact == 4, 0.0)
        .when((exact == 3) & same_y & same_m, 0.9)
        .when((exact == 3) & same_m & (gap <= 1), 0.6)
        .when((exact == 3) & same_y, 0.3)
        .when(exact == 3, 0.0)
        .when((exact == 2) & (gap <= 0), 0.8)
        .when((exact == 2) & (gap == 1), 0.6)
        .when((exact == 1) & (gap <= 0), 0.8)
        .when((exact == 1) & (gap <= 2), 0.6)
        .otherwise(0.0)
    )
    town = _ratio(a["town"], b["town"])
    no_town = (a["town"] == "") | (b["town"] == "")
    county = F.when((a["county"] != "") & (b["county"] != ""), a["county"] == b["county"])
    country = F.when((a["country"] != "") & (b["country"] != ""), F.arrays_overlap(F.split(a["country"], r"\|"), F.split(b["country"], r"\|")))
    # a town may go by two names; then the county still agrees
    place = F.when(no_town, F.when(~F.coalesce(county, country, F.lit(True)), 0.1).otherwise(0.5)).otherwise(F.greatest(town, F.when(F.coalesce(county, F.lit(False)), 0.3).otherwise(0.0)))
    return {"surname": surname, "first": first, "middle": middle, "date": date, "place": place}


def compared(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(l, r, v): the vectors of the pairs on the grid, each as one number. a and b are settled."""
    x = by_hash(a).select(F.col("rep").alias("l"), F.struct(*(c for c in a.columns if c != "rep")).alias("x"))
    y = by_hash(b).select(F.col("rep").alias("r"), F.struct(*(c for c in b.columns if c != "rep")).alias("y"))
    return _on_grid(pairs.join(x, "l").join(y, "r"))


def compared_few(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """As compared, for pairs that were counted: at most FEW. They go to the persons, who are not shuffled."""
    x = a.select(F.col("rep").alias("l"), F.struct(*(c for c in a.columns if c != "rep")).alias("x"))
    y = b.select(F.col("rep").alias("r"), F.struct(*(c for c in b.columns if c != "rep")).alias("y"))
    return _on_grid(y.join(F.broadcast(x.join(F.broadcast(pairs), "l")), "r"))


def _on_grid(met: DataFrame) -> DataFrame:
    v = _vector("x", "y")
    # the digits of v are the steps; the first similarity has the highest place
    return met.select("l", "r", reduce(lambda code, n: code * (GRID[n] + 1) + F.round(v[n] * GRID[n]).cast("int"), GRID, F.lit(0)).alias("v"))


def off_grid(v: np.ndarray) -> np.ndarray:
    """One row of similarities for each number of a vector."""
    return np.column_stack(np.unravel_index(v, [g + 1 for g in GRID.values()])) / np.array(list(GRID.values()), dtype=np.float64)


def all_vectors(a: DataFrame, b: DataFrame, found: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """As compared: the vectors of all pairs that share a block."""
    found = found or blocks(a, b)
    first, rest = compared(candidates(a, b, found), a, b), hot_rest(a, b, found)
    return first if rest is None else first.unionByName(rest)


class Mixture:
    """Two Gaussians with full, regularised covariances over weighted vectors."""

    def __init__(self, x: np.ndarray, counts: np.ndarray) -> None:
        self.x, self.counts = x, counts.astype(np.float64)
        mean = x.mean(axis=1)
        # matches are few; they start from the vectors that agree nearly throughout
        self.post = 1 / (1 + np.exp(-(mean - 0.85) * 40))
        self.maximise(self.post)

    def maximise(self, post: np.ndarray) -> None:
        self.share, self.mean, self.cov = [], [], []
        for p in (1 - post, post):
            w = self.counts * p + 1e-12
            self.share.append(w.sum())
            m = (w[:, None] * self.x).sum(axis=0) / w.sum()
            d = self.x - m
            self.mean.append(m)
            self.cov.append((w[:, None] * d).T @ d / w.sum() + RIDGE * np.eye(self.x.shape[1]))
        total = sum(self.share)
        self.share = [s / total for s in self.share]

    def expect(self) -> np.ndarray:
        log = []
        for s, m, c in zip(self.share, self.mean, self.cov, strict=True):
            d = self.x - m
            log.append(np.log(s + 1e-300) - 0.5 * (np.linalg.slogdet(c)[1] + np.einsum("ij,ij->i", d @ np.linalg.inv(c), d)))
        z = np.clip(log[1] - log[0], -500, 500)
        # more agreement in every part is never less likely a match: a Gaussian's far side would say so
        above = (self.x >= self.mean[1]).all(axis=1)
        return np.where(above, np.maximum(1 / (1 + np.exp(-z)), 0.999), 1 / (1 + np.exp(-z)))

    def fit(self, rounds: int) -> None:
        for _ in range(rounds):
            before, self.post = self.post, self.expect()
            self.maximise(self.post)
            if np.abs(before - self.post).max() < 1e-5:
                break


def fit_posteriors(vectors: DataFrame, people: DataFrame) -> DataFrame:
    """(l, r, confidence) of the pairs whose posterior is not negligible.

    Pairs with one vector share one posterior, so EM runs over the distinct vectors with their numbers, at most the product
    of GRID. Then transitivity is enforced in each round: if l matches r best, another pair (l, r') can be no likelier than
    r and r' being one person allow, and likewise for r; the posteriors so bounded go into the next maximisation, until they
    settle.
    """
    spark = vectors.sparkSession
    table = vectors.groupBy("v").count().toPandas().sort_values("v", ignore_index=True)
    if not len(table):
        return spark.createDataFrame([], "l long, r long, confidence double")
    mix = Mixture(off_grid(table["v"].to_numpy()), table["count"].to_numpy())
    mix.fit(ROUNDS)
    bounded, rivals = None, None
    for _ in range(OUTER):
        table["p"] = mix.post
        known = spark.createDataFrame(table.loc[table["p"] > 0.01, ["v", "p"]], "v int, p double")
        # the vectors are bounded by the grid, so this side is
        scored = vectors.join(F.broadcast(known), "v").select("l", "r", "v", "p")
        if bounded is not None:
            drop_settled(bounded)
        bounded, rivals = _transitive(scored, people, mix, rivals)
        cut = bounded.groupBy("v").agg(F.sum("confidence").alias("mass")).toPandas()
        merged = table.merge(cut, on="v", how="left")
        before = mix.post
        mix.maximise(np.where(merged["mass"].notna(), merged["mass"].fillna(0) / merged["count"], mix.post))
        mix.post = mix.expect()
        if np.abs(before - mix.post).max() < SETTLED:
            break
    return bounded.select("l", "r", "confidence")


def _transitive(scored: DataFrame, people: DataFrame, mix: Mixture, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(bounded, rivals): bounds each posterior by those of the best match of either side; linear in the pairs, no pairs within a group arise.

    people has the persons of both sides. The rivals of both are compared in one join; those known from a former round aren't
    compared again.
    """
    met = scored
    for side, other in (("l", "r"), ("r", "l")):
        best = Window.partitionBy(side).orderBy(F.desc("p"), F.desc(other)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = met.select("*", F.first(other).over(best).alias(f"best_{other}"), F.first("p").over(best).alias(f"top_{side}"))
    met = settle(met)
    # a pair that is the best of both sides has no rival
    alone = (F.col("r") == F.col("best_r")) & (F.col("l") == F.col("best_l"))
    contested = met.where(~alone)
    pair = lambda x, y: F.when(F.col(x) != F.col(y), F.struct(F.least(x, y).alias("l"), F.greatest(x, y).alias("r")))
    rivals = contested.select(F.explode(F.array_compact(F.array(pair("r", "best_r"), pair("l", "best_l")))).alias("v")).select("v.l", "v.r").repartition("l").distinct()
    # a record that matches both under two surnames vouches for the surnames, not for the rest
    # after the first round few are new; written first, so that Spark knows how few
    new = settle(rivals if known is None else rivals.join(known.select("l", "r"), ["l", "r"], "left_anti"))
    some = new.count()
    if some or known is None:
        width = _width()
        new = settle((compared_few if some <= FEW else compared)(new, people, people).select("l", "r", (F.col("v") % width + GRID["surname"] * width).alias("v")))
        known = new if known is None else known.unionByName(new)
    # a row for each vector, bounded by the grid
    d = known.join(F.broadcast(_posterior(people.sparkSession, mix)), "v").select(F.col("l").alias("s1"), F.col("r").alias("s2"), "q")
    out = contested
    for side, top in (("r", "top_l"), ("l", "top_r")):
        keyed = out.withColumn("s1", F.least(side, f"best_{side}")).withColumn("s2", F.greatest(side, f"best_{side}"))
        bound = F.when(F.col("s1") == F.col("s2"), F.col("p")).otherwise(F.least("p", F.coalesce("q", F.lit(1.0)) / F.greatest(F.col(top), F.lit(0.01))))
        out = keyed.join(d, ["s1", "s2"], "left").withColumn("p", bound).drop("q", "s1", "s2")
    columns = ["l", "r", "v", F.col("p").alias("confidence")]
    out = settle(out.select(*columns).unionByName(met.where(alone).select(*columns)))
    drop_settled(met)
    return out, known


def _width() -> int:
    """The vectors of one similarity of surnames, which has the highest place."""
    return prod(g + 1 for n, g in GRID.items() if n != "surname")


def _posterior(spark: SparkSession, mix: Mixture) -> DataFrame:
    """(v, q) for each vector of equal surnames: whether two records of one source are one person. Within a source matches are as likely as not beforehand."""
    v = np.arange(_width()) + GRID["surname"] * _width()
    x, log = off_grid(v), []
    for m, c in zip(mix.mean, mix.cov, strict=True):
        log.append(-0.5 * (np.linalg.slogdet(c)[1] + np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(c), x - m)))
    p = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -500, 500)))
    return spark.createDataFrame(pd.DataFrame({"v": v, "q": np.where((x >= mix.mean[1]).all(axis=1), 1.0, p)}), "v int, q double")


def match(left: DataFrame, right: DataFrame, places: DataFrame, least: float = SURE, evidence: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, confidence): all pairs of rows that describe one person with at least this posterior.

    Both sides have id, full_name, alternate_names, birth_date and birth_place. Rows that compare alike are matched once and
    expanded at the end. evidence has full_name and alternate_names of more persons, from which only variants of given names are learned. Rows without a name match nothing; other missing parts neither speak for a match nor against it.
    """
    # both sides in one table: rows that compare alike share a rep, which differs between the sides
    parts = read_sources([left, right], reader_for(places), evidence).where("surname != '' or first != ''")
    read = settle(parts.withColumn("rep", F.xxhash64(*(c for c in parts.columns if c != "id"))).withColumn("row", F.monotonically_increasing_id()))
    drop_settled(parts)
    # of copies the first row stays; they are counted by their numbers, as whole rows would have to be sorted for it
    copies = settle(read.groupBy("rep").agg(F.min("row").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"))
    people = settle(read.drop("id").join(by_hash(copies), "rep", "left").where("kept is null or kept = row").drop("kept", "row"))
    sides = [people.where(F.col("side") == i) for i in (0, 1)]
    keys = settle(block_keys(people, "side"))
    ka, kb = (keys.where(F.col("side") == i).drop("side") for i in (0, 1))
    a, b = (p.drop("side") for p in sides)
    of_a, of_b = (read.where(F.col("side") == i).select("rep", "id") for i in (0, 1))
    vectors = settle(all_vectors(a, b, (ka, kb, hot_blocks(keys))))
    drop_settled(keys)
    found = fit_posteriors(vectors, people.drop("side")).where(F.col("confidence") >= least)
    x, y = of_a.select(F.col("rep").alias("l"), F.col("id").alias("left_id")), of_b.select(F.col("rep").alias("r"), F.col("id").alias("right_id"))
    return found.join(x, "l").join(y, "r").select("left_id", "right_id", "confidence")
