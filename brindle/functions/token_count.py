"""Pluggable token counters: Arrow-batched functions over a public vocabulary."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed value: the pre-tokenizer pattern of byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def _encoding(path: str):  # noqa: ANN202 (the library is optional)
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str) -> Callable[[Column], Column]:
    """A function that counts the tokens of a column; null for null."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(path)
        return pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="Int64")

    return count


def register_counters(spark: SparkSession, vocabularies: dict[str, str]) -> None:
    """Make token counters available to SQL by name."""
    for name, path in vocabularies.items():
        spark.udf.register(name, token_counter(path))
