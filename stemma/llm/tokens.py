"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary file; a parameter of every operator that counts tokens.
VOCABULARY = os.environ.get("STEMMA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(2)
def encoding(path: str):  # noqa: ANN201
    """The tokenizer of a .tiktoken file, loaded once per Python worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Replaces the column `text` by n_tokens, the number of tokens of the whole text; null and empty texts have 0."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest, F.lit(0).cast("long").alias("n_tokens")).schema

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            yield b[rest].assign(n_tokens=[len(encode(t)) if t else 0 for t in b[text]])

    return docs.select(*rest, text).mapInPandas(count, schema)
