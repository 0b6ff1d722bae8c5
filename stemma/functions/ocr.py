"""Text from optical recognition, normalized line by line."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_line_text(text: str | None) -> str | None:
    """ASCII by compatibility decomposition, blanks collapsed, blank and repeated lines dropped, order kept."""
    if text is None:
        return None
    ascii_text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    lines = dict.fromkeys(" ".join(line.split()) for line in ascii_text.splitlines())
    lines.pop("", None)
    return "\n".join(lines)


def normalize_ocr(col: str | Column) -> Column:
    """Null stays null. Unicode decomposition has no JVM expression, so this is an Arrow function."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(normalize_line_text)

    return run(col)


def distinct_lines(text: Column) -> Column:
    """Blanks collapsed, blank and repeated lines dropped, order kept; letters stay as they are. Null where nothing is left."""
    lines = F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " "))), lambda x: x != ""))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))
