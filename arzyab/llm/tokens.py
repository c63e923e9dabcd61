"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@cache
def encoder(path: str):
    """The tokenizer of a rank file; a bare name is looked up among the installed public vocabularies."""
    import public_tokenizers
    import tiktoken

    where = path if "/" in path else public_tokenizers.path(path)
    with open(where, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``tokens``: the whole text's number of tokens, 0 for NULL and empty text."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary).encode_ordinary
        for texts in batches:
            yield texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return df.withColumn("tokens", F.pandas_udf(_typed(count), "long")(F.col(text)))


def _typed(f):
    # pandas_udf reads the kind of function from evaluated hints
    f.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return f
