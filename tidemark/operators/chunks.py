"""Chunking, content hashes and incremental ingest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import chunk_id, fnv1a64_long
from tidemark.functions.text import language_of, words
from tidemark.operators import bpe
from tidemark.operators.common import made_once


def ranges(n: Column, target: int, overlap: int) -> Column:
    """Windows ``(start, end)`` over n words, the next beginning ``overlap`` words before the last one's end."""
    target = max(1, target)
    stride = target - overlap if 0 <= overlap < target else target
    count = F.when(n <= target, 1).otherwise(F.ceil((n - target) / stride) + 1)
    made = F.transform(F.sequence(F.lit(0), F.greatest(count.cast("int"), F.lit(1)) - 1), lambda i: F.struct((i * stride).alias("start"), F.least(i * stride + target, n).alias("end")))
    return F.when(n > 0, made).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def chunk_words(frames: DataFrame, target: int = 400, overlap: int = 40) -> DataFrame:
    """``(frame_id, chunk, start, end, text)``; texts that fit stay untouched."""
    rows = frames.select("frame_id", "text", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    cut = rows.select("frame_id", "text", "w", "n", F.posexplode(ranges(F.col("n"), target, overlap)).alias("chunk", "r"))
    text = F.when(F.col("n") <= target, F.col("text")).otherwise(F.array_join(F.slice("w", F.col("r.start") + 1, F.col("r.end") - F.col("r.start")), " "))
    return cut.select("frame_id", "chunk", F.col("r.start").alias("start"), F.col("r.end").alias("end"), text.alias("text"))


def chunk_bpe(frames: DataFrame, vocabulary: str, target: int = 400, overlap: int = 40) -> DataFrame:
    """``(frame_id, chunk, start, end, text)`` over byte-pair tokens of a vocabulary file; texts that fit stay untouched."""
    rows = made_once(frames.select("frame_id", "text"), ids=bpe.encode(F.col("text"), vocabulary)).filter(F.size("ids") > 0)
    cut = rows.select("frame_id", "text", "ids", F.size("ids").alias("n"), F.posexplode(ranges(F.size("ids"), target, overlap)).alias("chunk", "r"))
    part = bpe.decode(F.slice("ids", F.col("r.start") + 1, F.col("r.end") - F.col("r.start")), vocabulary)
    return cut.select("frame_id", "chunk", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.when(F.col("n") <= target, F.col("text")).otherwise(part).alias("text"))


_KEYWORD = re.compile(r"(?:class|struct|enum|namespace) \s*([\w:]+)", re.A)
_CALL = re.compile(r"([\w:~]+)\s*\(", re.A)
_FLOW = re.compile(r"(?:if|for|while|switch)[ (]|return ")


def symbol_of(lines: list[str]) -> str:
    """The first type, namespace or function-like name in the lines; comments and control flow are passed over."""
    for line in lines:
        line = line.strip(" \t\r\n\f\v")
        if not line or line.startswith(("//", "/*", "*")):
            continue
        if m := _KEYWORD.match(line):
            return m[1]
        opened, closed = line.find("("), line.find(")")
        if not _FLOW.match(line) and 0 < opened < closed and (m := re.search(r"[\w:~]+$", line[:opened].rstrip(), re.A)):
            return m[0]
    return ""


def line_windows(costs: list[int], target: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """``(first, last, tokens)`` of greedy windows of lines; the next begins with trailing lines of up to ``overlap`` tokens."""
    costs, target, start = [max(1, c) for c in costs], max(1, target), 0
    while start < len(costs):
        end, total = start, 0
        while end < len(costs) and (end == start or total + costs[end] <= target):
            total += costs[end]
            end += 1
            if total >= target:
                break
        yield start, end - 1, total
        if end == len(costs):
            return
        back, held = end, 0
        while back > start and held + costs[back - 1] <= max(0, overlap):
            back -= 1
            held += costs[back]
        start = max(back, start + 1)


def chunk_lines(files: DataFrame, target: int = 400, overlap: int = 40) -> DataFrame:
    """Chunk records of ``files(relative_path, text)`` with line numbers from 1, symbol, language, hash and id; blank chunks are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text in zip(pdf["relative_path"], pdf["text"], strict=True):
                lines = re.split(r"\r\n|\r|\n", text or "")
                if lines and not lines[-1]:
                    lines.pop()
                for first, last, tokens in line_windows([len(x.split()) for x in lines], target, overlap):
                    body = "\n".join(lines[first : last + 1])
                    if body.strip():
                        out.append((path, symbol_of(lines[first : last + 1]), first + 1, last + 1, tokens, body))
            yield pd.DataFrame(out, columns=["relative_path", "symbol", "line_start", "line_end", "token_estimate", "text"])

    cut = files.select("relative_path", "text").mapInPandas(run, "relative_path string, symbol string, line_start int, line_end int, token_estimate int, text string")
    rows = cut.withColumns({"language": language_of(F.col("relative_path")), "content_hash": fnv1a64_long(F.col("text")), "size_bytes": F.octet_length("text").cast("bigint")})
    return rows.withColumn("chunk_id", chunk_id(F.col("relative_path"), F.col("symbol"), F.col("line_start"), F.col("line_end"), F.col("content_hash")))


def file_digests(files: DataFrame) -> DataFrame:
    return files.select("relative_path", F.octet_length("text").cast("bigint").alias("size_bytes"), fnv1a64_long(F.col("text")).alias("content_hash"))


def unchanged(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.join(previous, ["relative_path", "size_bytes", "content_hash"], "left_semi")


def changed(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.join(previous, ["relative_path", "size_bytes", "content_hash"], "left_anti")


def not_processed(chunks: DataFrame, processed: DataFrame) -> DataFrame:
    return chunks.join(processed.select("chunk_id").distinct(), "chunk_id", "left_anti")


def refresh_status(fresh: DataFrame, stored: DataFrame, key: str = "entity", digest: str = "structural_hash") -> DataFrame:
    """Each fresh row with ``unchanged``, ``updated`` or ``indexed`` (new) by its hash against the stored one."""
    joined = fresh.join(stored.select(key, F.col(digest).alias("_old")), key, "left")
    return joined.withColumn("status", F.when(F.col("_old").isNull(), "indexed").when(F.col("_old") == F.col(digest), "unchanged").otherwise("updated")).drop("_old")


def upsert(stored: DataFrame, fresh: DataFrame, key: str = "entity") -> DataFrame:
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
