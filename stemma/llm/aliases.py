"""Which words of names stand for each other, learned from the names themselves: nicknames, other languages, slips."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.names import read_name, sound
from stemma.llm.segments import segment_join
from stemma.tables import settle

#: A word stands for another if so large a part of its records under two spellings pair them.
LEAST_SHARE = 0.2
#: A word is taken for a slip of a near one that is so many times as frequent, for the beginning of a longer one that is so many times as frequent.
SLIP_RATIO, CUT_RATIO = 50, 10


@F.pandas_udf(T.StringType())
def sounds(words: pd.Series) -> pd.Series:
    return words.map(lambda w: sound(w) if w is not None else None)


def is_short(word: Column) -> Column:
    """An initial or an abbreviation."""
    return (F.length(word) == 1) | word.endswith(".")


def abbreviates(brief: Column, word: Column) -> Column:
    """The letters of `brief` occur in `word` in their order, beginning with its first one."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(brief, r"\.", ""), "(.)", "$1.*"))
    return F.regexp(word, pattern)


def slips(words: DataFrame) -> DataFrame:
    """(x, y): for each group x that reads as a slip of a more frequent one, the nearest and most frequent y.

    words has (word, name, f): name is the group of the word, f the uses of the group. Words of 4 letters may differ by one edit, of
    7 by two, or by one swap of neighbours; 3 letters or more may be the beginning of a word that is longer by two. x must be
    far rarer than y; of two that occur once each the later one counts as the more frequent.
    """
    near = segment_join(words.select(F.col("word").alias("name")), [], short=4, long=7).select("a", "b")
    letters = words.where(F.length("word") >= 4).select("word", F.xxhash64(F.array_sort(F.split("word", ""))).alias("letters"))
    swapped = letters.alias("x").join(letters.alias("y"), "letters").where("x.word < y.word").select(F.col("x.word").alias("a"), F.col("y.word").alias("b")).where(F.levenshtein("a", "b", 2).between(0, 2))
    pairs = near.unionAll(swapped).distinct()
    # a swap is one slip
    d = F.least(F.levenshtein("a", "b"), F.when(F.array_sort(F.split("a", "")) == F.array_sort(F.split("b", "")), 1).otherwise(9)).alias("d")
    both = pairs.select(F.explode(F.array(F.struct("a", "b", d), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), d))).alias("p")).select("p.*")
    begun = words.where(F.length("word") >= 5).select(F.col("word").alias("b"), F.explode(F.expr("transform(sequence(3, length(word) - 2), i -> left(word, i))")).alias("a")).select("a", "b", F.lit(3).alias("d"))
    x, y = words.select(F.col("word").alias("a"), F.col("name").alias("x"), F.col("f").alias("fx")), words.select(F.col("word").alias("b"), F.col("name").alias("y"), F.col("f").alias("fy"))
    far = both.unionAll(begun).join(x, "a").join(y, "b").where((F.col("x") != F.col("y")) & (F.col("fx") <= 1 + F.col("fy") / F.when(F.col("d") == 3, CUT_RATIO).otherwise(SLIP_RATIO)) & (F.struct("fy", "y") > F.struct("fx", "x")))
    return far.groupBy("x").agg(F.max_by("y", F.struct(-F.col("d"), "fy", "y")).alias("y"))


def roots(parents: DataFrame) -> DataFrame:
    """(x, root) for parents (x, y), a forest with one parent for each x: pointers are doubled until they all rest on roots."""
    at = settle(parents.select("x", F.col("y").alias("root")))
    while True:
        onward = at.select(F.col("x").alias("root"), F.col("root").alias("onward"))
        moved = settle(at.join(onward, "root", "left").select("x", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        at = moved.select("x", "root")
        if moved.where("moved").isEmpty():
            return at


def word_classes(words: DataFrame, told: DataFrame, by_sound: bool = True) -> DataFrame:
    """(word, root): words with one root stand for each other; only words that differ from their root are given.

    words has (word, f), each word with its number of uses, told has (x, y, n): how often one owner's names have x in one
    spelling and y in another; x = y counts for x. Words of one sound are one. A word is bound to the more frequent one that its owners
    use beside it in the greatest number of cases, if those are LEAST_SHARE of all its cases; else to the word of which
    it is a slip. An abbreviation is bound only if nearly all its cases name one word, as it may stand for several. The root is
    the most frequent word of a class. Initials stand for themselves. Without by_sound words are compared as they are, and
    there are no slips.
    """
    named = words.where(F.length("word") > 1).withColumn("name", F.when(F.col("word").endswith(".") | F.lit(not by_sound), F.col("word")).otherwise(sounds("word"))).where("name != ''")
    # (word, name, own, f): the word, its group, its uses and those of the group
    known = settle(named.select("word", "name", F.col("f").alias("own"), F.sum("f").over(Window.partitionBy("name")).alias("f")))
    sides = told.where((F.length("x") > 1) & (F.length("y") > 1))
    side = lambda w, n, f: known.select(F.col("word").alias(w), F.col("name").alias(n), F.col("f").alias(f))
    ranked = (
        sides.join(side("x", "a", "fa"), "x").join(side("y", "b", "fb"), "y")
        .select(F.explode(F.when(F.col("x") == F.col("y"), F.array(F.struct("a", "fa", "b", "fb", "n"))).otherwise(F.array(F.struct("a", "fa", "b", "fb", "n"), F.struct(F.col("b").alias("a"), F.col("fb").alias("fa"), F.col("a").alias("b"), F.col("fa").alias("fb"), "n")))).alias("p"))
        .select("p.*").groupBy("a", "fa", "b", "fb").agg(F.sum("n").alias("n"))
        .withColumn("cases", F.sum("n").over(Window.partitionBy("a")))
        .where("a != b")
    )
    brief = F.col("a").endswith(".")
    fit = ranked.where(~F.col("b").endswith(".") & (brief | (F.struct("fb", "b") > F.struct("fa", "a")))).where(
        F.when(brief, (F.col("n") >= 2) & (F.col("n") >= 0.8 * F.col("cases"))).otherwise(F.col("n") >= LEAST_SHARE * F.col("cases"))
    )
    parents = fit.groupBy(F.col("a").alias("x")).agg(F.max_by("b", F.struct("n", "fb", "b")).alias("told"))
    if by_sound:
        guessed = slips(known.where(~F.col("word").endswith(".")).select("word", "name", "f"))
        parents = parents.join(guessed, "x", "full").select("x", F.coalesce("told", "y").alias("y"))
    else:
        parents = parents.withColumnRenamed("told", "y")
    at = roots(parents)
    placed = known.join(at.withColumnRenamed("x", "name"), "name", "left").withColumn("class", F.coalesce("root", "name"))
    best = F.max(F.when(~F.col("word").endswith("."), F.struct("own", "word"))).over(Window.partitionBy("class"))["word"]
    return settle(placed.select("word", best.alias("root")).where("word != root"))


def told_given(persons: DataFrame) -> DataFrame:
    """(x, y, n): the given names of a person's full_name beside those at the same place in alternate_names, with their number of cases."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, more in zip(b["full_name"], b["alternate_names"], strict=True):
                _, first, middle, _ = read_name(name)
                for other in more:
                    _, also, also_middle, _ = read_name(other)
                    out += [(x, y) for x, y in ((first, also), (middle, also_middle)) if x and y]
            yield pd.DataFrame(out, columns=["x", "y"])

    several = persons.where("full_name is not null and size(alternate_names) > 0").select("full_name", "alternate_names")
    return several.mapInPandas(read, "x string, y string").groupBy("x", "y").agg(F.count("*").alias("n"))


def with_roots(df: DataFrame, classes: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces the words in the columns by their roots. classes holds no row for a word that is its own root."""
    for c in columns:
        df = df.join(classes.select(F.col("word").alias(c), F.col("root").alias("__root")), c, "left").withColumn(c, F.coalesce("__root", c)).drop("__root")
    return df


def given_classes(read: DataFrame, persons: DataFrame) -> DataFrame:
    """(word, root) of the given names that read holds, as word_classes learns them from persons with several spellings."""
    # written first: else the sounds of all names are asked for before equal ones are counted
    uses = settle(read.select(F.explode(F.array("first", "middle")).alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("f")))
    told = settle(told_given(persons))
    # words that only the other spellings of other people have
    more = told.select(F.explode(F.array("x", "y")).alias("word")).distinct().join(uses.select("word"), "word", "left_anti").withColumn("f", F.lit(0).cast("long"))
    return word_classes(uses.unionByName(more), told)
