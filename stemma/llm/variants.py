"""Variant spellings of names: a pigeonhole segment join, verified by banded edit distance, and the classes it leads to."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.llm.aliases import LEAST_SHARE, abbreviates, given_classes, is_short, with_roots, word_classes
from stemma.llm.components import components
from stemma.llm.names import read_name, read_words
from stemma.llm.segments import LONG, SHORT, segment_join
from stemma.tables import settle

__all__ = ["LONG", "SHORT", "class_pairs", "name_classes", "read_forms", "segment_join"]

_TEXT, _WORDS = T.StringType(), T.ArrayType(T.StringType())
READ = T.StructType([
    T.StructField("at", T.IntegerType()), *(T.StructField(n, _TEXT) for n in ("surname", "first", "middle", "suffix")), T.StructField("words", _WORDS), T.StructField("suffix_0", _TEXT), T.StructField("words_0", _WORDS),
])
PERSON, ORGANISATION = "person", "organisation"
#: A word beside more different words than this is no name of its own, if the rarest word of its name has a tenth of them at most.
COMPANY = 10


def read_spellings(rows: DataFrame, row_id: str, group: str) -> DataFrame:
    """(row_id, group, type, at, surname, first, middle, suffix, words, suffix_0, words_0): one row for each spelling, read both as a person and as words.

    at is 0 for the first spelling of a row; the others also have the suffix and the words of the first. Empty and null names give none.
    """
    names = F.array_distinct(F.filter(F.concat(F.array("full_name"), F.coalesce("alternate_names", F.array().cast("array<string>"))), lambda s: F.trim(s) != ""))
    spelled = rows.select(row_id, group, F.coalesce("name_type", F.lit("")).alias("type"), names.alias("names")).where(F.size("names") > 0)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of, out = [], []
            for i, spellings in enumerate(b["names"]):
                first = None
                for at, name in enumerate(spellings):
                    one = (*read_name(name), read_words(name))
                    of.append(i)
                    out.append((at, *one, first and first[3], first and first[4]))
                    first = first or one
            yield pd.concat([b.drop(columns="names").iloc[of].reset_index(drop=True), pd.DataFrame(out, columns=READ.names)], axis=1)

    schema = spelled.drop("names").schema
    return spelled.mapInPandas(read, T.StructType([*schema.fields, *READ.fields]))


def tell_types(read: DataFrame, row_id: str) -> DataFrame:
    """Replaces an unstated type by the likelier one, judged by the words of the spellings whose type is stated.

    Words count by how much more frequent they are in one type; unknown ones say nothing. Without evidence a name is a person's.
    """
    stated = read.where(F.col("type").isin(PERSON, ORGANISATION)).select((F.col("type") == ORGANISATION).cast("int").alias("o"), F.explode("words").alias("word"))
    uses = stated.groupBy("word").agg(F.sum("o").alias("o"), F.sum(1 - F.col("o")).alias("p"))
    totals = uses.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("all_o"), F.coalesce(F.sum("p"), F.lit(0)).alias("all_p"))
    # totals is one row
    weighed = uses.join(F.broadcast(totals), F.lit(True)).select(
        "word", (F.log((F.col("o") + 0.1) / (F.col("all_o") + 1)) - F.log((F.col("p") + 0.1) / (F.col("all_p") + 1))).alias("weight")
    )
    unstated = read.where(~F.col("type").isin(PERSON, ORGANISATION)).select(row_id, F.explode("words").alias("word"))
    told = unstated.join(weighed, "word").groupBy(row_id).agg(F.sum("weight").alias("weight"))
    # a prior as the totals have it
    prior = totals.select(F.log((F.col("all_o") + 1) / (F.col("all_p") + 1)).alias("prior"))
    # few rows: those without a stated type that read as organisations
    told = settle(told.join(F.broadcast(prior), F.lit(True)).where(F.col("weight") + F.col("prior") > 0).select(row_id, F.lit(ORGANISATION).alias("likely")))
    typed = read.join(told, row_id, "left")
    return typed.withColumn("type", F.when(F.col("type").isin(PERSON, ORGANISATION), F.col("type")).otherwise(F.coalesce("likely", F.lit(PERSON)))).drop("likely")


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.where("x is not null and y is not null and x != '' and y != ''").groupBy("x", "y").agg(F.count("*").alias("n"))


def _expansions(words: DataFrame) -> DataFrame:
    """(word, root): each abbreviation of words (word, f) with the most frequent word that it abbreviates."""
    brief = words.where(F.col("word").endswith(".")).select(F.col("word").alias("brief"), F.substring("word", 1, 1).alias("c"), F.expr("substring(word, length(word) - 1, 1)").alias("e"))
    whole = words.where(~F.col("word").endswith(".") & (F.length("word") > 1)).select("word", "f", F.substring("word", 1, 1).alias("c"), F.explode(F.array_distinct(F.split("word", ""))).alias("e"))
    fit = brief.join(whole, ["c", "e"]).where((F.length("word") >= F.length("brief")) & abbreviates(F.col("brief"), F.col("word")))
    return fit.groupBy("brief").agg(F.max_by("word", F.struct("f", "word")).alias("root")).select(F.col("brief").alias("word"), "root")


def read_organisations(orgs: DataFrame, row_id: str, group: str) -> DataFrame:
    """(row_id, group, at, kind, surname): the distinctive words of each organisation's spelling, and the class of its other words.

    Words are unified first: those that owners use in place of each other, slips, and abbreviations. A word is distinctive
    if it stands beside few different words, itself or compared with the others of its name. The rest, such as
    "historical society", is a frame; frames are of one kind if owners use them in place of each other.
    """
    words = orgs.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("f"))
    # what the first spelling of a row has where another one has something else, or the same
    only_a, only_b, shared = F.array_except("words_0", "words"), F.array_except("words", "words_0"), F.array_intersect("words_0", "words")
    one = F.when((F.size(only_a) == 1) & (F.size(only_b) == 1), F.array(F.struct(F.get(only_a, F.lit(0)).alias("x"), F.get(only_b, F.lit(0)).alias("y"))))
    same = F.transform(shared, lambda w: F.struct(w.alias("x"), w.alias("y")))
    told = _counted(orgs.where("at > 0").select(F.explode(F.concat(same, F.coalesce(one, F.array().cast("array<struct<x: string, y: string>>")))).alias("t")).select("t.*"))
    classes = word_classes(words, told)
    bound = classes.select("word")
    expanded = _expansions(words).join(bound, "word", "left_anti")
    classes = settle(classes.unionByName(with_roots(expanded, classes.select("word", "root"), ["root"])))
    marked = orgs.withColumn("spelling", F.xxhash64(row_id, "at"))
    flat = with_roots(marked.select(row_id, group, "at", "spelling", F.explode("words").alias("word")), classes, ["word"])
    read = settle(flat.groupBy(row_id, group, "at", "spelling").agg(F.array_sort(F.collect_set("word")).alias("words")))
    each = read.select("words", F.explode("words").alias("word"))
    # the different words beside a word, at least so many
    beside = each.select("word", F.explode("words").alias("other")).where("word != other").distinct().groupBy("word").agg(F.count("*").alias("company"))
    counted = read.select(row_id, group, "at", "spelling", F.explode("words").alias("word")).join(beside, "word", "left").fillna(0, ["company"])
    most = F.max("company").over(Window.partitionBy("spelling"))
    split = counted.withColumn("own", (F.col("company") <= COMPANY) | (F.col("company") * 10 <= most)).groupBy(row_id, group, "at", "spelling").agg(
        F.array_sort(F.collect_set(F.when(F.col("own"), F.col("word")))).alias("own"), F.array_sort(F.collect_set(F.when(~F.col("own"), F.col("word")))).alias("frame")
    )
    split = settle(split.select(
        row_id, group, "at", F.array_join(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("frame")), "").alias("surname"),
        F.when(F.size("own") > 0, F.array_join("frame", " ")).otherwise("").alias("frame"),
    ).withColumn("surname", F.regexp_replace("surname", r"\.", "")).withColumn("frame", F.regexp_replace("frame", r"\.", "")))
    frames = split.where("frame != ''").groupBy(F.col("frame").alias("word")).agg(F.count("*").alias("f"))
    firsts = split.where("at = 0").select(row_id, F.col("frame").alias("x"))
    kinds = word_classes(frames, _counted(split.where("at > 0").select(row_id, F.col("frame").alias("y")).join(firsts, row_id)), by_sound=False)
    return with_roots(split, kinds.select("word", "root"), ["frame"]).select(row_id, group, "at", F.concat(F.lit("organisation "), F.col("frame")).alias("kind"), "surname")


def read_forms(rows: DataFrame, row_id: str, group: str, evidence: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(row_id, group, at, kind, surname, first, middle, suffix) for each spelling of each row, and whether suffixes are left out at times.

    kind is empty for a person, else what sort of organisation it is. Given names are replaced by their roots.
    """
    read = settle(read_spellings(rows, row_id, group))
    typed = tell_types(read, row_id)
    people = typed.where(F.col("type") == PERSON).drop("words", "words_0")
    spelled = rows.where(F.col("name_type") == PERSON).select("full_name", "alternate_names")
    classes = given_classes(people, spelled if evidence is None else spelled.unionByName(evidence.select("full_name", "alternate_names")))
    persons = with_roots(people, classes, ["first", "middle"]).select(row_id, group, "at", F.lit("").alias("kind"), "surname", "first", "middle", "suffix")
    orgs = read_organisations(typed.where(F.col("type") == ORGANISATION).select(row_id, group, "at", "words", "words_0"), row_id, group)
    orgs = orgs.select(row_id, group, "at", "kind", "surname", *(F.lit("").alias(c) for c in ("first", "middle", "suffix")))
    # how often one row has a name with and without a suffix
    cut = F.count_if(F.col("suffix") != F.col("suffix_0")).alias("cut")
    kept = people.where("at > 0 and (suffix != '' or suffix_0 != '')").agg(F.count("*").alias("all"), cut).first()
    return persons.unionByName(orgs).where("surname != '' or first != ''"), ((kept["cut"] or 0) + 1) >= LEAST_SHARE * ((kept["all"] or 0) + 1)


def name_classes(rows: DataFrame, row_id: str = "nameid", group: str = "tree_file", evidence: DataFrame | None = None) -> DataFrame:
    """(row_id, group, class_id): rows of a group with one class name the same person or organisation.

    Every row with a name is in one class; class_id is the smallest row id of it. Names are read into parts first.
    Surnames by sound within few edits are found by `segment_join` inside a group, kind and initial; given names must have one
    root or be an initial or abbreviation of the other, middle names and suffixes must not contradict. A form with an initial
    only, without a middle name or without a suffix joins fuller forms only if the nearest of those (of the same surname
    first) agree on what it stands for; else it stays with its like. If rows with several spellings hardly ever leave
    a suffix out, forms without one stay apart from those with one. Rows in null groups are taken as one group. evidence has the
    full_name and alternate_names of other persons; which given names stand for each other is learned from them, too.
    """
    keyed = rows.withColumn(group, F.coalesce(F.col(group), F.lit("")))
    read, suffix_free = read_forms(keyed, row_id, group, evidence)
    parts = ["surname", "first", "middle", "suffix"]
    forms = settle(read.withColumn("block", F.xxhash64(group, "kind", F.substring("first", 1, 1))).withColumn("form", F.xxhash64(group, "kind", *parts)))
    distinct = settle(forms.select("form", "block", *parts).distinct())
    near = segment_join(distinct.select("block", F.col("surname").alias("name")), ["block"])
    # both directions of one pass
    near = near.select("block", F.levenshtein("a", "b").alias("d"), F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("block", "p.a", "p.b", "d")
    own = distinct.select("block", F.col("surname").alias("a")).distinct().select("block", "a", F.col("a").alias("b"), F.lit(0).alias("d"))
    x = distinct.select("block", F.col("surname").alias("a"), F.col("form").alias("fx"), *(F.col(c).alias(f"{c}_x") for c in parts[1:]))
    y = distinct.select("block", F.col("surname").alias("b"), F.col("form").alias("fy"), *(F.col(c).alias(f"{c}_y") for c in parts[1:]))
    both = settle(near.unionAll(own).join(x, ["block", "a"]))
    # equal given names meet by hash; only short ones are tried against all of their initial
    equal = both.join(y.withColumn("first_x", F.col("first_y")), ["block", "b", "first_x"])
    brief = both.where(is_short(F.col("first_x"))).join(y, ["block", "b"]).where((F.col("first_x") != F.col("first_y")) & abbreviates(F.col("first_x"), F.col("first_y")))
    cols = ["fx", "fy", "d", *(f"{c}_{s}" for c in parts[1:] for s in "xy")]
    turned = [F.col("fy").alias("fx"), F.col("fx").alias("fy"), "d", *(F.col(f"{c}_{t}").alias(f"{c}_{s}") for c in parts[1:] for s, t in (("x", "y"), ("y", "x")))]
    mx, my = F.col("middle_x"), F.col("middle_y")
    fits = (mx == my) | (mx == "") | (my == "") | (is_short(mx) & abbreviates(mx, my)) | (is_short(my) & abbreviates(my, mx))
    sx, sy = F.col("suffix_x"), F.col("suffix_y")
    fits = fits & ((sx == sy) | (F.lit(suffix_free) & ((sx == "") | (sy == ""))))
    pairs = equal.select(*cols).unionAll(brief.select(*cols)).unionAll(brief.select(*turned)).where((F.col("fx") != F.col("fy")) & fits)
    pairs = settle(pairs.distinct())
    # what an incomplete form could stand for, told by the nearest of its fuller neighbours
    whole = {"first": F.when(~is_short(F.col("first_y")), F.col("first_y")), "middle": F.when((my != "") & ~is_short(my), my), "suffix": F.when(sy != "", sy)}
    by_distance = pairs.groupBy("fx", "d").agg(*(g(e).alias(f"{c}_{n}") for c, e in whole.items() for n, g in (("lo", F.min), ("hi", F.max))))
    told = by_distance.groupBy("fx").agg(*(F.min(F.when(F.col(f"{c}_lo").isNotNull(), F.struct("d", F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_hi").alias("hi")))).alias(c) for c in whole))
    told = told.select("fx", *(F.when(F.col(f"{c}.lo") == F.col(f"{c}.hi"), F.col(f"{c}.lo")).otherwise("").alias(f"told_{c}") for c in whole))
    other = told.select(F.col("fx").alias("fy"), *(F.col(f"told_{c}").alias(f"also_{c}") for c in whole))
    agree = F.lit(True)
    for c in whole:
        a, b = F.col(f"{c}_x"), F.col(f"{c}_y")
        lacks = lambda w: (w == "") | is_short(w)
        agree = agree & ~(lacks(a) & ~lacks(b) & (b != F.col(f"told_{c}"))) & ~(lacks(b) & ~lacks(a) & (a != F.col(f"also_{c}")))
    links = pairs.where("fx < fy").join(told, "fx").join(other, "fy").where(agree).select(F.col("fx").alias("u"), F.col("fy").alias("v"))
    # spellings of one row belong together: its forms are linked to its smallest one
    several = settle(forms.where("at > 0").select(row_id).distinct())
    theirs = settle(forms.join(several, row_id, "left_semi").select(row_id, "form"))
    least = theirs.groupBy(row_id).agg(F.min("form").alias("v"))
    same_row = theirs.join(least, row_id).where("form != v").select(F.col("form").alias("u"), "v").distinct()
    found = components(links.unionAll(same_row))
    placed = forms.join(found, F.col("form") == F.col("node"), "left").select(row_id, group, F.coalesce("component", "form").alias("c"))
    per_row = placed.groupBy(row_id, group).agg(F.min("c").alias("c"))
    return per_row.join(per_row.groupBy("c").agg(F.min(row_id).alias("class_id")), "c").select(row_id, group, "class_id")


def class_pairs(classes: DataFrame, row_id: str = "nameid") -> DataFrame:
    """(nameid_a, nameid_b), a < b, of the rows of one class. The pairs are the result; classes of one row give none."""
    a, b = classes.select(F.col(row_id).alias("nameid_a"), "class_id"), classes.select(F.col(row_id).alias("nameid_b"), "class_id")
    return a.join(b, "class_id").where("nameid_a < nameid_b").select("nameid_a", "nameid_b")
