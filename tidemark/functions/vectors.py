"""Vector functions as column expressions over arrays, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import ascii_lower


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def magnitude(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    both = magnitude(a) * magnitude(b)
    return F.when(both == 0, 0.0).otherwise(dot(a, b) / both)


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def normalize(v: Column) -> Column:
    """Of length one; empty and zero vectors stay."""
    n = magnitude(v)
    return F.when(n == 0, _double(v)).otherwise(F.transform(_double(v), lambda x: x / n))


def is_normalized(v: Column, tolerance: float = 1e-3) -> Column:
    return (F.size(v) > 0) & (F.abs(magnitude(v) - 1) <= tolerance)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: x - y)


def scale(v: Column, by: float) -> Column:
    return F.transform(_double(v), lambda x: x * F.lit(float(by)))


def is_finite(v: Column) -> Column:
    return ~F.exists(_double(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def identity_tag(provider: str | None, model: str | None, dimensions: int | None, normalized: bool | None) -> str:
    """How an embedding was made; empty if a part holds control characters or the tag exceeds 4096 bytes."""
    parts = [("provider", provider), ("model", model), ("dimensions", dimensions), ("normalized", None if normalized is None else str(normalized).lower())]
    tag = ";".join(f"{k}={v}" for k, v in parts if v not in (None, ""))
    return "" if any(ord(c) < 32 or ord(c) == 127 for c in tag) or len(tag.encode()) > 4096 else tag


def hashed_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), ascii_lower)
