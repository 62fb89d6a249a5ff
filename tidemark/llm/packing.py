"""Packing along a space-filling curve.

A document's bag of tokens is hashed to ``_BUCKETS`` counts, scaled to length one, projected to three dimensions and
placed on a Hilbert curve.  The rows are range-partitioned and sorted by that key; each partition is then cut into
sequences as it streams by, so documents of like content share sequences.  Token ids are written once, as 16-bit
values where the vocabulary allows it, and shuffled once; equal keys (copies) are spread by a second sort column.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, width
from tidemark.llm.tokens import batches_of, default_vocabulary, encoder

_BUCKETS, _DIMS, _BITS, _SEED = 1024, 3, 16, 20_240_101
_TASK = 32 << 20  # ids that a task packs


def projection() -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((_BUCKETS, _DIMS))


def hilbert_key(cells: np.ndarray) -> np.ndarray:
    """Positions along the Hilbert curve of integer points ``(n, dims)`` with ``_BITS`` bits a dimension."""
    x = cells.astype(np.int64).T.copy()
    dims, q = len(x), 1 << (_BITS - 1)
    while q > 1:  # undo the excess work of each level
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (_BITS - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for bit in range(_BITS - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_points(bags: list[np.ndarray], plane: np.ndarray) -> np.ndarray:
    """Grid cells of hashed bags: each coordinate is about normal, so its normal rank fills the grid evenly."""
    out = np.zeros((len(bags), _DIMS), np.int64)
    for row, ids in enumerate(bags):
        counts = np.bincount((ids.astype(np.uint32) * np.uint32(2_654_435_761)) >> np.uint32(22), minlength=_BUCKETS)
        place = counts @ plane / max(1.0, math.sqrt(float((counts * counts).sum())))
        out[row] = [min((1 << _BITS) - 1, int((1 << _BITS) * 0.5 * (1 + math.erf(v / math.sqrt(2))))) for v in place]
    return out


def tokenize(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """``(id, key, tie, n_tokens, ids)``; ids as little-endian unsigned 16- or 32-bit values with ``end_id`` last."""

    def run(batches):
        own, plane = encoder(vocabulary), projection()
        end = np.array([end_id], np.uint32)
        for batch in batches:
            k = 0
            for texts in batches_of([x or "" for x in batch.column(1).to_pylist()]):
                bags = [np.concatenate([ids, end]) for ids in own.encode_all(texts)]
                raw = [x.astype("<u4" if own.wide else "<u2").tobytes() for x in bags]
                columns = [batch.column(0).slice(k, len(texts)), pa.array(hilbert_key(curve_points(bags, plane)), pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([len(x) for x in bags], pa.int64()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "tie", "n_tokens", "ids"])
                k += len(texts)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, key long, tie long, n_tokens long, ids binary")


class _Sequences:
    """Cuts a stream of documents into sequences of ``size`` ids; what is left at the end goes into powers of two."""

    def __init__(self, size: int, first: int, payload: bool):
        self.size, self.number, self.payload = size, first, payload
        self.open: list[tuple] = []  # (id, start, ids, n_tokens) of the sequence that is being filled
        self.filled, self.rows = 0, []

    def add(self, key, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while at < n:
            take = min(self.size - self.filled, n - at)
            self.open.append((key, at, ids[at : at + take], n))
            self.filled, at = self.filled + take, at + take
            if self.filled == self.size:
                self._close(self.open)
                self.open, self.filled = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, n in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((key, start, len(ids), zlib.crc32(raw), n, self.number, offset, *([raw] if self.payload else [])))
            offset += len(ids)
        self.number += 1

    def finish(self) -> None:
        left, pieces = self.filled, self.open
        for bit in range(left.bit_length() - 1, -1, -1):
            if left >> bit & 1:
                room, taken = 1 << bit, []
                while room:
                    key, start, ids, n = pieces[0]
                    taken.append((key, start, ids[:room], n))
                    pieces = [*([(key, start + room, ids[room:], n)] if len(ids) > room else []), *pieces[1:]]
                    room -= len(taken[-1][2])
                self._close(taken)
        self.open, self.filled = [], 0

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, vocabulary: str | None = None, end_id: int = 2, payload: bool = False) -> DataFrame:
    """One row per piece: ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``.

    Every id of every document lies in exactly one piece; a document without text is its end id alone; null ids and
    repeated rows are packed like any other row; further columns are ignored; an empty table gives no pieces.
    Sequences have ``size`` ids, but for a partition's last ones, whose lengths are powers of two: nothing is padded.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    written = ws.table(tokenize(docs, id_col, text_col, vocabulary or default_vocabulary(), end_id), "tokens", compression="zstd")
    kind = written.dtypes[0][1]
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if payload else [])]

    def run(batches):
        cut = _Sequences(size, TaskContext.get().partitionId() << 36, payload)

        def rows():
            columns = list(zip(*cut.take(), strict=True)) or [[] for _ in names]
            types = [id_type, *[pa.int64()] * 6, *([pa.binary()] if payload else [])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, n, raw in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                b, n = raw.as_py(), n.as_py()
                cut.add(key.as_py(), np.frombuffer(b, "<u2" if len(b) == 2 * n else "<u4"))
                if len(cut.rows) >= 4096:
                    yield rows()
        cut.finish()
        if cut.rows:
            yield rows()

    total = written.agg(F.sum("n_tokens")).first()[0] or 0
    tasks = max(width(spark), -(-total // _TASK))  # however few partitions the session asks for
    ordered = written.repartitionByRange(tasks, "key", "tie", "id").sortWithinPartitions("key", "tie", "id").select("id", "n_tokens", "ids")
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if payload else "")
    return ordered.mapInArrow(run, schema).withColumnRenamed("id", id_col)
