"""Hashes as column expressions."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a64(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, 16 hex digits; two 32-bit limbs, so nothing overflows."""
    prime_low, mask = F.lit(435).cast("bigint"), F.lit((1 << 32) - 1).cast("bigint")
    hexed = F.hex(F.encode(text, "UTF-8"))
    n = (F.length(hexed) / 2).cast("int")
    octets = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.substr(hexed, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))

    def step(a: Column, x: Column) -> Column:
        low = a["lo"].bitwiseXOR(x)
        return F.struct((a["hi"] * prime_low + F.shiftright(low * prime_low, 32) + low * F.lit(256).cast("bigint")).bitwiseAND(mask).alias("hi"), (low * prime_low).bitwiseAND(mask).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))
    return F.lower(F.aggregate(octets, start, step, lambda a: F.concat(F.lpad(F.hex(a["hi"]), 8, "0"), F.lpad(F.hex(a["lo"]), 8, "0"))))


def _digests(text: pd.Series) -> pd.Series:
    def digest(x: str | None) -> str | None:
        if x is None:
            return None
        h = 0xCBF29CE484222325
        for b in x.encode():
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return text.map(digest)


def fnv1a64_long(text: Column) -> Column:
    """The same of long texts such as whole files, where a loop over bytes in Python is faster than one over array columns."""
    return F.pandas_udf(_digests, "string")(text)


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def chunk_id(path: Column, symbol: Column, start: Column, end: Column, content_hash: Column) -> Column:
    return fnv1a64(F.concat_ws("\n", path, symbol, F.concat_ws(":", start.cast("string"), end.cast("string")), content_hash))
