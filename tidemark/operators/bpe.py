"""Counting, encoding and cutting texts with a byte-pair vocabulary of ``base64 rank`` lines."""

from __future__ import annotations

import base64
from functools import cache

import pandas as pd
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How texts are cut before merging: contractions, words with one sign before them, short numbers, signs, white space.
PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


@cache
def encoding(path: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The worker's encoding of a vocabulary file; lines that cannot be read are left out."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, _, rank = line.strip().partition(b" ")
            if rank.isdigit():
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: Column, path: str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        own = encoding(path)
        return texts.map(lambda t: None if t is None else own.encode_ordinary(t))

    return F.pandas_udf(run, "array<int>")(text)


def count(text: Column, path: str) -> Column:
    return F.size(encode(text, path))


def decode(ids: Column, path: str) -> Column:
    def run(rows: pd.Series) -> pd.Series:
        own = encoding(path)
        return rows.map(lambda x: None if x is None else own.decode(list(x)))

    return F.pandas_udf(run, "string")(ids)


def truncate(text: Column, n: int, path: str) -> Column:
    return decode(F.slice(encode(text, path), 1, n), path) if n > 0 else F.lit("")
