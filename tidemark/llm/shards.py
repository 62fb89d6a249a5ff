"""Token sequences in training order, as fixed-stride binary shards.

Documents are tokenised and cut, one after another, into sequences of ``length`` ids; the sequences are written once
and numbered without gaps from the counts of the tasks that wrote them.  A keyed Feistel network over the next power
of four, walked until it falls inside the range, permutes those numbers: every sequence gets a global slot of its own.
Slots are range-partitioned into shards of ``per_shard`` records of one size, so record ``s`` of the training order
lies in shard ``s // per_shard`` at byte ``(s % per_shard) * stride``; reading on from any slot is sequential.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, width
from tidemark.llm.tokens import batches_of, default_vocabulary, encoder
from tidemark.llm.warc import _open_fs

_ROUNDS = 6


def feistel(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """The keyed permutation of 0 .. total-1, at these numbers."""
    half = max(1, ((max(1, total - 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    seeds = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(_ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        high, low = x >> np.uint64(half), x & mask
        for seed in seeds:
            f = (low ^ seed) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            high, low = low, high ^ ((f >> np.uint64(32)) & mask)
        return (high << np.uint64(half)) | low

    out = once(numbers.astype(np.uint64))
    while (outside := np.flatnonzero(out >= np.uint64(total))).size:  # cycle walking
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def cut_sequences(docs: DataFrame, id_col: str, text_col: str, length: int, vocabulary: str, end_id: int) -> DataFrame:
    """``(part, at, n_tokens, docs, starts, ids)``: sequence ``at`` of the task ``part``.

    ``ids`` is a record of ``length`` little-endian values, filled up with ``end_id``; ``docs`` and ``starts`` name the
    documents whose ids it holds and where each one's begin in it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind_of_id = rows.dtypes[0][1]

    def run(batches):
        own = encoder(vocabulary)
        kind, part = np.dtype("<u4" if own.wide else "<u2"), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        open_ids, filled, docs_in, starts, at, rows = [], 0, [], [], 0, []

        def record() -> None:
            nonlocal open_ids, filled, docs_in, starts, at
            ids = np.concatenate([*open_ids, np.full(length - filled, end_id, np.uint32)])
            rows.append((part, at, filled, docs_in, starts, ids.astype(kind).tobytes()))
            open_ids, filled, docs_in, starts, at = [], 0, [], [], at + 1

        def made() -> pa.RecordBatch:
            types = [pa.int64()] * 3 + [pa.list_(id_type), pa.list_(pa.int64()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "at", "n_tokens", "docs", "starts", "ids"])
            rows.clear()
            return out

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            keys = iter(batch.column(0).to_pylist())
            for texts in batches_of([x or "" for x in batch.column(1).to_pylist()]):
                for ids in own.encode_all(texts):
                    key, ids, k = next(keys), np.concatenate([ids, end]), 0
                    while k < len(ids):
                        take = min(length - filled, len(ids) - k)
                        docs_in.append(key)
                        starts.append(filled)
                        open_ids.append(ids[k : k + take])
                        filled, k = filled + take, k + take
                        if filled == length:
                            record()
                if len(rows) >= 1024:
                    yield made()
        if filled:
            record()
        if rows:
            yield made()

    return rows.mapInArrow(run, f"part long, at long, n_tokens long, docs array<{kind_of_id}>, starts array<bigint>, ids binary")


def write_shards(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, per_shard: int = 4096, key: int = 1, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the shards below ``folder`` (the shared folder, if none is given) and returns the index of their records.

    ``(slot, sequence, shard, byte_offset, n_tokens, crc32, docs, starts)``, one row per sequence, crc32 being that of
    the record's bytes.  A shard is written under a temporary name and renamed; one that stands there whole, with the
    same checksum, is left as it is, so a run that broke off goes on where it ended.  Null texts are their end id
    alone; ids of any type are listed as they are, null ones as null; repeated rows are written each; further columns are ignored; an empty table
    writes no shard and gives no rows.  Documents are numbered as the table's files are split, so another split gives
    another training order.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "shards")
    folder = folder or f"{ws.path}/shards"
    cut = ws.table(cut_sequences(docs, id_col, text_col, length, vocabulary or default_vocabulary(), end_id), "sequences", compression="zstd")
    counts = {r["part"]: r["n"] for r in cut.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()}  # one row a task
    total = sum(counts.values())
    first = dict(zip(counts, (np.cumsum(list(counts.values())) - list(counts.values())).tolist(), strict=True))

    def place(batches):
        pack = zstandard.ZstdCompressor(level=3)  # the shuffle's own codec makes little of ids
        for batch in batches:
            start = np.array([first[p] for p in batch.column(0).to_pylist()], np.int64)
            sequence = start + batch.column(1).to_numpy()
            slot = feistel(sequence, total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(sequence), pa.array(slot // per_shard), *batch.columns[2:5], pa.array([pack.compress(x.as_py()) for x in batch.column(5)], pa.binary())], names=["slot", "sequence", "shard", "n_tokens", "docs", "starts", "ids"])

    listed = dict(cut.dtypes)["docs"]
    placed = cut.mapInArrow(place, f"slot long, sequence long, shard long, n_tokens long, docs {listed}, starts array<bigint>, ids binary")
    shards = max(1, -(-total // per_shard))
    tasks = min(shards, width(spark))

    def write(batches):
        fs, base = _open_fs(folder)
        fs.create_dir(base, recursive=True)
        shard, held, rows, unpack = None, [], [], zstandard.ZstdDecompressor()

        def close() -> None:
            """Writes the shard unless it is there already."""
            if shard is None:
                return
            name, raw = f"{base}/shard-{shard:06d}.bin", b"".join(held)
            if fs.get_file_info(name).type == pafs.FileType.File:
                with fs.open_input_stream(name) as old:
                    if zlib.crc32(old.read()) == zlib.crc32(raw):
                        return
                fs.delete_file(name)
            temporary = f"{base}/.shard-{shard:06d}.{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(temporary) as out:
                out.write(raw)
            fs.move(temporary, name)

        def made() -> pa.RecordBatch:
            types = [pa.int64()] * 6 + [ids_type, pa.list_(pa.int64())]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["slot", "sequence", "shard", "byte_offset", "n_tokens", "crc32", "docs", "starts"])
            rows.clear()
            return out

        ids_type = None
        for batch in batches:
            ids_type = batch.schema.field(4).type
            for slot, sequence, own, n, ids_of, starts, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != shard:
                    close()
                    shard, held = own, []
                raw = unpack.decompress(raw)
                held.append(raw)
                rows.append((slot, sequence, own, slot % per_shard * len(raw), n, zlib.crc32(raw), ids_of, starts))
            if rows:
                yield made()
        close()

    # the ranges are known, so nothing is sampled; a task writes a run of shards
    ordered = placed.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {shards} as int)")).sortWithinPartitions("shard", "slot")
    schema = f"slot long, sequence long, shard long, byte_offset long, n_tokens long, crc32 long, docs {listed}, starts array<bigint>"
    return ws.table(ordered.mapInArrow(write, schema), "index", compression="zstd")


def read_from(folder: str, slot: int, length: int = 1024, per_shard: int = 4096, item: str = "<u2") -> Iterator[np.ndarray]:
    """The records of the training order from ``slot`` on, shard after shard."""
    fs, base = _open_fs(folder)
    stride = length * np.dtype(item).itemsize
    shard, skip = divmod(slot, per_shard)
    while fs.get_file_info(name := f"{base}/shard-{shard:06d}.bin").type == pafs.FileType.File:
        with fs.open_input_file(name) as source:
            source.seek(skip * stride)
            while raw := source.read(stride):
                yield np.frombuffer(raw, item)
        shard, skip = shard + 1, 0
