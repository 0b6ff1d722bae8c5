"""Text normalization as Spark expressions; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and the plain letters they fold to.
ACCENTED = "àáâãäåāăąçćčďèéêëēęěìíîïīłñńňòóôõöøōőřśšşťùúûüūůűýÿźżž"
PLAIN = "aaaaaaaaacccdeeeeeeeiiiiilnnnoooooooorssstuuuuuuuyyzzz"
assert len(ACCENTED) == len(PLAIN)


def squash(col: Column) -> Column:
    """Trimmed text with runs of white space as one blank."""
    return F.trim(F.regexp_replace(col, r"[\s ​]+", " "))


def fold(col: Column) -> Column:
    """Lower case without accents; also without combining marks left by decomposed text."""
    bare = F.regexp_replace(F.lower(col), r"\p{M}+", "")
    return F.replace(F.translate(bare, ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))


def key_text(col: Column, prefix: int | None = None) -> Column:
    """Only a-z and 0-9 of the lower-cased text, at most `prefix` of them; null counts as empty."""
    key = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]", "")
    return F.substring(key, 1, prefix) if prefix else key


def filled(col: Column) -> Column:
    """The trimmed text, null where nothing is left."""
    text = F.trim(col)
    return F.when(F.length(text) > 0, text)


def name_split(col: Column) -> Column:
    """struct(given, surname): `Given /Surname/`, else the last token is the surname."""
    text = F.coalesce(col, F.lit(""))
    slashed = F.regexp_extract(text, r"^([^/]*)/([^/]*)/", 2)
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) > 0)
    n = F.size(words)
    given = F.when(text.rlike(r"^[^/]*/[^/]*/"), F.trim(F.regexp_extract(text, r"^([^/]*)/", 1))).when(n > 1, F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), " ")).otherwise(F.when(n == 1, words[0]).otherwise(""))
    surname = F.when(text.rlike(r"^[^/]*/[^/]*/"), F.trim(slashed)).when(n > 1, F.try_element_at(words, F.lit(-1))).otherwise("")
    return F.struct(given.alias("given"), surname.alias("surname"))


def sha_key(*parts: Column) -> Column:
    """The hash of texts, a line each; null counts as empty."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(p, F.lit("")) for p in parts)), 256)
