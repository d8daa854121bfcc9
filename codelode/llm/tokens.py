"""Token counts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ranks of a byte-level vocabulary; see the README of that folder.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that this vocabulary's texts are split with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """The number of tokens of each text; null texts have none."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return F.coalesce(count(text), F.lit(0).cast("bigint"))
