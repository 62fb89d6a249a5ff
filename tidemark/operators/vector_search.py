"""Exact nearest vectors, hashed embeddings and the choice of which texts to embed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import hashed_tokens, is_finite
from tidemark.operators.common import top_k

METRICS = ("cosine", "dot", "l2")


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.stack([-((x - v) ** 2).sum(axis=1) for v in q])
    product = q @ x.T
    if metric == "dot":
        return product
    both = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
    return np.divide(product, both, out=np.zeros_like(product), where=both > 0)


def knn_exact(vectors: DataFrame, queries: DataFrame, metric: str = "cosine", k: int = 10, block: int = 2048, digits: int = 6) -> DataFrame:
    """``(query_id, rank, frame_id, score)``: the k best of ``vectors(frame_id, embedding)`` for ``queries(query_id, embedding)``.

    Every vector is compared with every query, queries in blocks of ``block``, so what each task holds is bounded; each
    batch of vectors passes on its k best only.  Scores are cosine, dot product or minus the squared distance; vectors
    of another length raise an error.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    spark, parts = vectors.sparkSession, None
    total = queries.count()
    rows = vectors.select("frame_id", F.col("embedding").cast("array<double>").alias("v"))
    for n in range(blocks := max(1, -(-total // block))):
        own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)
        asked = [(r["query_id"], r["embedding"]) for r in own.collect()]
        if not asked:
            continue
        ids, q = [i for i, _ in asked], np.array([v for _, v in asked], float)
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                if (lengths != q.shape[1]).any():
                    raise ValueError("vectors and queries differ in length")
                scores = np.round(_scores(np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1), q, metric), digits)
                keys = batch.column(0).to_numpy()
                order = np.lexsort((np.broadcast_to(keys, scores.shape), -scores), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, order.shape[1])), pa.array(keys[order.ravel()]), pa.array(np.take_along_axis(scores, order, 1).ravel())], names=["query_id", "frame_id", "score"])

        found = rows.mapInArrow(run, "query_id long, frame_id long, score double")
        parts = found if parts is None else parts.union(found)
    if parts is None:
        return spark.createDataFrame([], "query_id long, rank int, frame_id long, score double")
    return top_k(parts, ["query_id"], [F.desc("score"), F.asc("frame_id")], max(1, k)).select("query_id", "rank", "frame_id", "score")


def hash_embedding(frames: DataFrame, dim: int = 384) -> DataFrame:
    """``(frame_id, embedding)``: signed feature hashing (FNV-1a) of the text's ASCII tokens, of length one."""

    def fnv(token: bytes) -> int:
        h = 0xCBF29CE484222325
        for b in token:
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        for batch in batches:
            out = np.zeros((batch.num_rows, dim))
            for row, tokens in enumerate(batch.column(1).to_pylist()):
                for t in tokens or ():
                    if t not in known:
                        if len(known) > 500_000:
                            known.clear()
                        h = fnv(t.encode())
                        known[t] = (h % dim, -1 if h >> 63 else 1)
                    out[row, known[t][0]] += known[t][1]
            norm = np.linalg.norm(out, axis=1)
            out[norm > 0] /= norm[norm > 0, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * dim, pa.int32()), pa.array(out.ravel()))], names=["frame_id", "embedding"])

    return frames.select("frame_id", hashed_tokens(F.col("text")).alias("tokens")).mapInArrow(run, "frame_id long, embedding array<double>")


def embed_texts(frames: DataFrame, encoder: Callable[[list[str]], list[list[float]]], batch: int = 32, attempts: int = 3) -> DataFrame:
    """``(frame_id, embedding)`` from a model client: each distinct text is sent once, in batches, and retried on errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(0).to_pylist()
            for k in range(0, len(texts), batch):
                for left in range(attempts - 1, -1, -1):
                    try:
                        got = encoder(texts[k : k + batch])
                        break
                    except OSError:
                        if not left:
                            raise
                yield pa.RecordBatch.from_arrays([pa.array(texts[k : k + batch]), pa.array([list(map(float, v)) for v in got], pa.list_(pa.float64()))], names=["text", "embedding"])

    made = frames.select("text").distinct().mapInArrow(run, "text string, embedding array<double>")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    made = made.withColumn("embedding", F.when(norm == 0, F.col("embedding")).otherwise(F.transform("embedding", lambda x: x / norm)))
    return frames.join(made, "text").select("frame_id", "embedding")


def embed_with_memo(frames: DataFrame, memo: DataFrame, encoder: Callable[[list[str]], list[list[float]]], batch: int = 32) -> tuple[DataFrame, DataFrame]:
    """``(frame_id, embedding)`` and the next memo ``(digest, embedding)``; texts whose digest is known are not sent again."""
    digest = F.sha2(F.encode("text", "UTF-8"), 256)
    rows = frames.select("frame_id", "text", digest.alias("digest"))
    known = memo.select("digest", "embedding").dropDuplicates(["digest"])
    new = rows.join(known, "digest", "left_anti").groupBy("digest").agg(F.min("frame_id").alias("frame_id"), F.min("text").alias("text"))
    made = embed_texts(new.select("frame_id", "text"), encoder, batch).join(new.select("frame_id", "digest"), "frame_id").select("digest", "embedding")
    after = known.unionByName(made)
    return rows.join(after, "digest").select("frame_id", "embedding"), after


def latest_valid(journal: DataFrame) -> DataFrame:
    """``journal(seq, frame_id, embedding)``: the last usable vector of each frame; its length is that of the first usable one."""
    good = journal.filter((F.size("embedding") > 0) & is_finite(F.col("embedding")))
    dim = good.agg(F.min_by(F.size("embedding"), "seq").alias("dim"))
    fit = good.crossJoin(F.broadcast(dim)).filter(F.size("embedding") == F.col("dim"))
    return fit.groupBy("frame_id").agg(F.max_by("embedding", "seq").alias("embedding"))


def reuse_or_embed(frames: DataFrame, stored: DataFrame, dim: int, identity: str) -> tuple[DataFrame, DataFrame]:
    """Splits frames into those whose stored vector can be used again and those to embed."""
    usable = stored.filter((F.size("embedding") == dim) & is_finite(F.col("embedding")) & ((F.coalesce("identity", F.lit("")) == "") | F.lit(identity == "") | (F.col("identity") == identity)))
    keep = frames.join(usable.select("frame_id", "embedding"), "frame_id")
    return keep, frames.join(usable.select("frame_id"), "frame_id", "left_anti")
