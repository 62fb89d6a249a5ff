"""The stateful operators on Structured Streaming."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import chunks as C
from tidemark.operators import store as S

FOLDED = "frame_id long, seq long, status int, text string, superseded_by long, rejected long"
_STATE = "seq long, status int, text string, superseded_by long, rejected long"


def fold_stream(mutations: DataFrame) -> DataFrame:
    """The state of each frame after every micro-batch of ``(seq, kind, frame_id, other_id, text)``.

    A key's rows count in order of ``seq``; those not above its last one are rejected and counted.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, status, text, newer, rejected = state.get if state.exists else (-1, -1, None, None, 0)
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if r.seq <= seq:
                rejected += 1
                continue
            seq = int(r.seq)
            if r.kind == "put" and status < 0:
                status, text = 0, r.text
            elif r.kind == "delete" and status >= 0:
                status = 1
            elif r.kind == "supersede" and status >= 0 and newer is None and r.other_id != key[0]:
                newer = int(r.other_id)
        state.update((seq, status, text, newer, rejected))
        yield pd.DataFrame({"frame_id": [key[0]], "seq": [seq], "status": [status], "text": [text], "superseded_by": pd.array([newer], dtype="Int64"), "rejected": [rejected]})

    return mutations.groupBy("frame_id").applyInPandasWithState(fold, FOLDED, _STATE, "update", GroupStateTimeout.NoTimeout)


def access_stream(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Accesses per frame and day of ``(frame_id, ts)``, closed once the watermark has passed."""
    return log.withWatermark("ts", late).groupBy("frame_id", F.window("ts", "1 day")).agg(F.count("*").alias("accesses"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("events"))


FILES = "relative_path string, size_bytes long, content_hash string, batch long"
CHUNKS = "relative_path string, symbol string, line_start int, line_end int, token_estimate int, text string, language string, content_hash string, size_bytes long, chunk_id string, batch long"
STATUS = "batch long, files long, unchanged long, chunks long, facts long, seconds double"


def checked_name(name: str) -> str:
    """A name for checkpoints: letters, digits, ``_`` and ``-`` only; it may be empty."""
    if not re.fullmatch(r"[A-Za-z0-9_-]*", name):
        raise ValueError(f"{name!r} is no name of letters, digits, _ and -")
    return name


def checked_range(name: str, value: int, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be a whole number from {low} to {high}")
    return value


def _latest(log: DataFrame, key: str = "relative_path") -> DataFrame:
    return log.groupBy(key).agg(F.max("batch").alias("batch"))


def indexed_files(store: S.FrameStore) -> DataFrame:
    """The latest version of each file that was ingested."""
    log = store.read_or_empty("files", FILES)
    return log.join(_latest(log), ["relative_path", "batch"], "left_semi")


def indexed(store: S.FrameStore, table: str = "chunks", schema: str = CHUNKS, path: str = "relative_path") -> DataFrame:
    """Chunks (or facts) of the latest version of each file; those of versions before it are left out."""
    latest = _latest(store.read_or_empty("files", FILES)).withColumnRenamed("relative_path", path)
    return store.read_or_empty(table, schema).join(latest, [path, "batch"], "left_semi")


def ingest_stream(files: DataFrame, store: S.FrameStore, enrich: Callable[[DataFrame], DataFrame] | None = None, checkpoint: str | None = None, interval: str | None = None, namespace: str = "", target: int = 400, overlap: int = 40):
    """Starts the index job over a stream of ``(relative_path, text)``.

    Every micro-batch leaves out files whose digest is the known one, chunks and enriches the rest, and appends its rows
    to ``files``, ``chunks``, ``facts`` and ``index_status``, each with the batch's number, as one generation; what the
    store held is not written again, and other tables in it are left alone.  A batch that is given again after a failure
    appends nothing.  ``indexed`` shows what counts now; ``checkpoint`` (and ``namespace`` below it) resumes the job,
    ``query.stop()`` cancels it.
    """
    checked_range("target", target, 1, 1_000_000)
    checked_range("overlap", overlap, 0, target)
    if checkpoint and checked_name(namespace):
        checkpoint = f"{checkpoint}/{namespace}"

    def step(batch: DataFrame, number: int) -> None:
        began = time.monotonic()
        status = store.read_or_empty("index_status", STATUS)
        if status.filter(F.col("batch") == number).take(1):
            return
        own = batch.dropDuplicates(["relative_path"])
        digests = C.file_digests(own)
        fresh = C.changed(digests, indexed_files(store).drop("batch"))
        rows = C.chunk_lines(own.join(fresh.select("relative_path"), "relative_path", "left_semi"), target, overlap).withColumn("batch", F.lit(number).cast("bigint"))
        store.stage({}, {"files": fresh.withColumn("batch", F.lit(number).cast("bigint")), "chunks": rows})
        held = lambda table: store.read(table, staged=True).filter(F.col("batch") == number)
        facts = 0
        if enrich:
            store.stage({}, {"facts": enrich(held("chunks").drop("batch")).withColumn("batch", F.lit(number).cast("bigint"))})
            facts = held("facts").count()
        all_files, new = digests.count(), held("files").count()
        row = (number, new, all_files - new, held("chunks").count(), facts, time.monotonic() - began)
        store.commit(append={"index_status": batch.sparkSession.createDataFrame([row], STATUS)})

    writer = files.writeStream.foreachBatch(step)
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def throughput(status: DataFrame) -> DataFrame:
    """One row of what an index job did: batches, files, chunks and facts, and chunks per second (0 if no time passed)."""
    rows = status.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "unchanged", "chunks", "facts")], F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.count("*").alias("batches"))
    return rows.withColumn("chunks_per_second", F.when(F.col("seconds") > 0, F.round(F.col("chunks") / F.col("seconds"), 6)).otherwise(0.0))


def read_folder(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
