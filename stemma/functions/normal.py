"""Values in one comparable form: composed and squashed text, places, values by the tag they stand under, confidences."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.functions.dates import with_normalized_dates
from stemma.functions.places import country

# Tags whose values are words of a fixed list, so that case says nothing.
CONTROLLED_TAGS = ("ADOP", "MEDI", "PEDI", "QUAY", "ROLE", "SEX", "STAT", "TYPE")
MOST_TAG = 31


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


def normal_space(text: Column) -> Column:
    """Composed Unicode, trimmed, white space as single blanks; null stays null. Composition has no JVM expression."""
    return F.trim(F.regexp_replace(_composed(text), r"[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+", " "))


def normal_place(text: Column) -> Column:
    """Parts of a place by commas, in their order: no full stop or semicolon after a word, folded case; the last is a country under its usual name."""
    parts = F.transform(F.split(text, ","), lambda p: F.lower(F.regexp_replace(F.trim(F.regexp_replace(p, r"\s+", " ")), r"(?<=[\p{L}\p{N}_])[.;](?=\s|$)", "")))
    last = F.element_at(parts, -1)
    return F.array_join(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.coalesce(country(last), F.lit("")))), ",")


def with_normal_values(df: DataFrame, tag: str, value: str, out: str) -> DataFrame:
    """Adds `out`: the value as its tag compares it. Dates in the standard form, countries and places by name, names and values of fixed lists without case, others as written."""
    t, v = F.col(tag), F.col("__v")
    df = df.withColumn("__v", normal_space(F.coalesce(F.col(value), F.lit(""))))
    df = with_normalized_dates(df, {"__v": "__date"})
    form = (
        F.when(t == "DATE", F.upper("__date")).when(t == "CTRY", F.coalesce(country(v), F.lit(""))).when(t == "PLAC", normal_place(v))
        .when(t.isin(*CONTROLLED_TAGS, "NAME"), F.lower(v)).otherwise(v)
    )
    return df.withColumn(out, form).drop("__v", "__date")


def confidence(text: Column) -> Column:
    """A finite number from 0 to 1, else 0; truth values and whatever is no number are 0."""
    number = F.trim(text.cast("string")).try_cast("double")
    return F.when(number.between(0.0, 1.0) & ~F.isnan(number), number).otherwise(F.lit(0.0))


def retained_tag(name: Column) -> Column:
    """The tag under which an unmapped column is kept: `_RM_` and its letters, digits and underscores in upper case, 31 characters at most."""
    return F.substring(F.concat(F.lit("_RM_"), F.upper(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"))), 1, MOST_TAG)


def markdown(text: Column) -> Column:
    """Text for a cell of a Markdown table: backslashes and bars escaped, line ends as blanks, trimmed; null is empty."""
    escaped = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.trim(F.regexp_replace(escaped, r"[\r\n]", " "))


def byte_prefix(text: Column, most: int) -> Column:
    """The longest beginning of a text that has at most so many UTF-8 bytes and ends between characters."""
    data = F.encode(text, "UTF-8")
    cut = F.hex(F.substring(data, 1, most))
    # bytes from 80 to BF at the cut belong to a character that doesn't fit; its beginning goes
    split = F.hex(F.substring(data, most + 1, 1)).rlike("^[89AB]")
    whole = F.when(split, F.regexp_replace(cut, "[C-F][0-9A-F](?:[89AB][0-9A-F])*$", "")).otherwise(cut)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.unhex(whole), "UTF-8"))


def cell(value: Column, kind: T.DataType) -> Column:
    """A result cell as text of JSON or plain text: bytes and numbers that are not finite become small objects, nulls stay null."""
    if isinstance(kind, T.BinaryType):
        return F.when(value.isNotNull(), F.concat(F.lit('{"data":"'), F.base64(value), F.lit('","encoding":"base64"}')))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        odd = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
        word = F.when(F.isnan(value), "nan").when(value > 0, "inf").otherwise("-inf")
        return F.when(value.isNull(), None).when(odd, F.concat(F.lit('{"data":"'), word, F.lit('","encoding":"float"}'))).otherwise(value.cast("string"))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")


def cells(df: DataFrame) -> DataFrame:
    """Every column as `cell` gives it; names must be unique and not empty."""
    if not df.columns or any(not c for c in df.columns) or len(set(df.columns)) < len(df.columns):
        raise ValueError("a result needs columns with unique names that are not empty")
    return df.select(*(cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))
