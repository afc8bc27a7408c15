"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files on every executor; a parameter of all that counts tokens.
FOLDER = "/opt/tokenizers"
# Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoding(folder: str, name: str = "byte_bpe_50k.tiktoken"):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | Column, folder: str = FOLDER) -> Column:
    """Tokens of a whole text; null and empty text have none. Words of any length are merged in linear-log time."""

    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(folder).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, T.LongType())(text)
