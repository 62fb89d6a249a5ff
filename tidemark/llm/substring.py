"""Repeated passages: a log-structured index of window fingerprints, exact verification, removal.

A window is ``window`` consecutive words.  Each is filed under its anchor, the smallest of the hashes of the
``_GRAM``-word runs inside it.  Equal windows have equal anchors wherever they stand, and neighbouring windows mostly
share theirs, so the index holds about one hash for every 13 words instead of one for each.

The index is a log of immutable runs, each a table of ``(hash, n)`` sorted by hash.  A new batch becomes such a run and
is merge-joined with the others; hashes met before, or twice in the batch, are hits; runs of one level are then
compacted into one of the next.  Windows whose anchor was hit are verified by a 128-bit digest of
their whole word sequence, which is counted over all texts; only words under windows counted twice are removed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from itertools import accumulate, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, delete_path, fresh, settings, width

_GRAM = 10
_SEED = 77


def split_words(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text between ASCII white space (blank and ``\\x09-\\x0D``)."""
    return (text or b"").split()


class WordHashes:
    """64-bit hashes of words, remembered for the most recent ones."""

    def __init__(self, most: int = 200_000):
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w, _SEED)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_anchors(hashes: np.ndarray, window: int, gram: int = _GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor, and the hashes of the ``gram``-word runs; both empty if the text is shorter than a window."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - gram + 1 + j]
    runs = _mixed(runs).view(np.int64)
    span, low, reach = window - gram + 1, runs, 1
    while 2 * reach <= span:
        low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    return low, runs


def anchor_list(hashes: np.ndarray, window: int) -> np.ndarray:
    """A text's distinct anchors; one that stands at several places is listed twice."""
    low, runs = window_anchors(hashes, window)
    if not len(low):
        return low
    anchors = np.unique(low)
    values, counts = np.unique(runs, return_counts=True)
    again = anchors[counts[np.searchsorted(values, anchors)] > 1]
    return np.concatenate([anchors, again])


class FingerprintLog:
    """A log-structured index of hashes in a folder that outlives the process.

    A run is an immutable table of ``(hash, n)``, hashed to ``buckets`` files each sorted by hash, so runs meet in
    merge joins that neither shuffle nor sort.  A batch becomes a run of level 0; two runs of one level are merged into
    one of the next, so few runs are left however many batches came.  A manifest names the runs that count; it is
    replaced by renaming, so a broken ``add`` leaves the log as it was and can be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        fs, folder = self._fs()
        versions = sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().startswith("manifest-")) if fs.exists(folder) else []
        if versions:
            state = json.loads(spark.read.text(f"{path}/{versions[-1]}", wholetext=True).first()[0])
        else:
            state = {"buckets": buckets or width(spark), "runs": [], "made": 0, "batches": 0}
        self.buckets, self.made, self.batches = state["buckets"], state["made"], state["batches"]
        self.runs: list[tuple[str, int]] = [tuple(r) for r in state["runs"]]
        self.tables: dict[str, str] = {}

    def _fs(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _commit(self) -> None:
        fs, _ = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        name = f"{self.path}/manifest-{self.made:06d}.json"
        out = fs.create(path(name + ".tmp"), True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "runs": self.runs, "made": self.made, "batches": self.batches}).encode()))
        out.close()
        fs.delete(path(name), False)
        if not fs.rename(path(name + ".tmp"), path(name)):
            raise OSError(f"cannot rename {name}")
        for f in fs.listStatus(path(self.path)):
            old = f.getPath().getName()
            if old.startswith("manifest-") and old < f"manifest-{self.made:06d}" or old.startswith("run-") and old not in dict(self.runs):
                fs.delete(f.getPath(), True)

    def _run(self, rows: DataFrame) -> str:
        name, self.made = f"run-{self.made:06d}", self.made + 1
        delete_path(self.spark, f"{self.path}/{name}")
        self.tables[name] = f"tidemark_{uuid.uuid4().hex}"
        with self._sorted():
            rows.write.format("parquet").bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.path}/{name}").saveAsTable(self.tables[name])
        return name

    def _sorted(self):
        """Each bucket is one sorted file, and Spark may rely on it."""
        return settings(self.spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true", spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__sources__bucketing__autoBucketedScan__enabled="false")

    def _read(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = f"tidemark_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.tables[name]} (hash BIGINT, n BIGINT) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(self.tables[name])

    def add(self, hashes: DataFrame, ws: Workspace) -> DataFrame:
        """Appends a batch of ``(hash)`` rows, repeats included; returns those of its hashes that the log or the batch held before."""
        counted = hashes.groupBy("hash").agg(F.count("*").alias("n"))  # summed before the shuffle, so a hot hash is one row a task
        new = self._run(counted if self.buckets == width(self.spark) else counted.repartition(self.buckets, "hash"))
        batch = self._read(new)
        found = batch.filter("n > 1").select("hash")
        for name, _ in self.runs:
            found = found.union(batch.select("hash").join(self._read(name).select("hash").hint("merge"), "hash"))
        with self._sorted():
            hits = ws.table(found.distinct(), f"hits-{new}")
        self.runs.append((new, 0))
        while len(self.runs) > 1 and self.runs[-1][1] == self.runs[-2][1]:
            self._merge_last()
        self.batches += 1
        self._commit()
        return hits

    def _merge_last(self) -> None:
        (low, level), (high, _) = self.runs[-2:]
        a, b = self._read(low).alias("a"), self._read(high).alias("b").hint("merge")
        both = a.join(b, F.col("a.hash") == F.col("b.hash"), "full_outer")
        self.runs[-2:] = [(self._run(both.select(F.coalesce("a.hash", "b.hash").alias("hash"), (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"))), level + 1)]

    def close(self) -> None:
        """Takes the runs out of the session's catalogue; the files stay."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables.clear()


def _marked(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``(id, k1, k2, n_words, sha, anchors)``; k1 and k2 are two hashes of the text, sha what results if nothing goes."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).select("id", F.xxhash64(F.lit(1), "text").alias("k1"), F.xxhash64(F.lit(2), "text").alias("k2"), "text")

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            out = []
            for x in batch.column(3):
                words = split_words(x.as_py())
                out.append((len(words), hashlib.sha256(b" ".join(words)).hexdigest(), anchor_list(hashes(words), window)))
            ends = np.concatenate([[0], np.cumsum([len(a) for *_, a in out])])
            anchors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *[a for *_, a in out]])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([n for n, *_ in out], pa.int64()), pa.array([s for _, s, _ in out], pa.string()), anchors], names=["id", "k1", "k2", "n_words", "sha", "anchors"])

    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, k1 long, k2 long, n_words long, sha string, anchors array<long>")


def _first_copies(docs: DataFrame, text_col: str) -> DataFrame:
    """``(k1, k2, text)`` with most copies of a text already left out by the task that reads them."""
    rows = docs.select(F.col(text_col).cast("binary").alias("text")).select(F.xxhash64(F.lit(1), "text").alias("k1"), F.xxhash64(F.lit(2), "text").alias("k2"), "text")

    def run(batches):
        seen = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            fresh = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
            if len(seen) > 200_000:  # copies that slip through are left out later
                seen.clear()
            yield batch.take(pa.array(fresh, pa.int64()))

    return rows.mapInArrow(run, "k1 long, k2 long, text binary")


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """``(k1, k2, d1, d2, at, copies)``: digest and start of each window whose anchor was hit."""

    names = ["k1", "k2", "copies", "d1", "d2", "at"]

    def run(batches):
        hashes, held, n = WordHashes(), [], 0

        def made() -> pa.RecordBatch:
            keys = np.repeat(np.array([x[:3] for x in held], np.int64), [len(x[4]) for x in held], axis=0)
            two = np.frombuffer(b"".join([x[3] for x in held]), "<i8").reshape(-1, 2)
            columns = [*(np.ascontiguousarray(keys[:, c]) for c in range(3)), np.ascontiguousarray(two[:, 0]), np.ascontiguousarray(two[:, 1]), np.concatenate([x[4] for x in held]).astype(np.int32)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

        for batch in batches:
            for k1, k2, text, copies, hit in zip(*batch.columns, strict=True):
                words = split_words(text.as_py())
                low, _ = window_anchors(hashes(words), window)
                hit = np.sort(hit.values.to_numpy())
                at = np.flatnonzero(hit[np.minimum(np.searchsorted(hit, low), len(hit) - 1)] == low)
                joined = b" ".join(words)
                ends = np.fromiter(accumulate(map(len, words)), np.int64, len(words)) + np.arange(len(words))
                starts = np.concatenate([[0], ends[:-1] + 1])
                digest = xxhash.xxh3_128_digest
                for k in range(0, len(at), 50_000):
                    part = at[k : k + 50_000]
                    raw = b"".join([digest(joined[a:b]) for a, b in zip(starts[part].tolist(), ends[part + window - 1].tolist(), strict=True)])
                    held.append((k1.as_py(), k2.as_py(), copies.as_py(), raw, part))
                    n += len(part)
                    if n >= 50_000:
                        yield made()
                        n = 0
        if held:
            yield made()

    return texts.mapInArrow(run, "k1 long, k2 long, copies long, d1 long, d2 long, at int")


def _kept(texts: DataFrame, window: int) -> DataFrame:
    """``(k1, k2, n_removed, kept)`` of texts that lose words; ``kept`` is the rest, joined by blanks."""

    def run(batches):
        for batch in batches:
            gone_of, kept_of = [], []
            for text, starts in zip(batch.column(2), batch.column(3), strict=True):
                words = split_words(text.as_py())
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.unique(starts.values.to_numpy())
                edge[at] += 1
                edge[at + window] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                gone_of.append(int(gone.sum()))
                kept_of.append(b" ".join(compress(words, (~gone).tolist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone_of, pa.int64()), pa.array(kept_of, pa.binary())], names=["k1", "k2", "n_removed", "kept"])

    return texts.mapInArrow(run, "k1 long, k2 long, n_removed long, kept binary")


class Repeats:
    """What a search leaves: ``marks`` has a row for each input row, ``cut`` one for each text that loses words."""

    def __init__(self, marks: DataFrame, cut: DataFrame):
        self.marks, self.cut = marks, cut


def _verified(ws: Workspace, marks: DataFrame, sources: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """``(k1, k2, n_removed, kept)`` of the texts of rows marked ``own`` that lose words.

    Texts with a hit anchor are fetched once; their windows are counted by digest over all rows of ``marks``.
    """
    copies = marks.filter(F.col("n_words") >= window).groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.max("own").alias("own"))
    held = marks.filter(F.size("anchors") > 0).dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode(F.array_distinct("anchors")).alias("hash"))
    flagged = held.join(hits, "hash").groupBy("k1", "k2").agg(F.collect_list("hash").alias("hit")).join(copies, ["k1", "k2"])
    texts = ws.table(sources.join(flagged, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "text", "copies", "hit", "own"), "texts", small=True, compression="zstd")
    seen = lambda rows: _windows(rows.drop("own"), window)  # noqa: E731  made twice, which takes less than to keep a row for every window
    # written, so that both sides of the join are plain exchanges and a passage that many texts share can be split
    twice = ws.table(seen(texts).groupBy("d1", "d2").agg(F.sum("copies").alias("n")).filter("n > 1").select("d1", "d2"), "twice", small=True, compression="zstd")
    starts = ws.table(seen(texts.filter("own")).join(twice, ["d1", "d2"]).groupBy("k1", "k2").agg(F.collect_list("at").alias("starts")), "starts", small=True, compression="zstd")
    ws.drop("twice")
    cut = ws.table(_kept(texts.select("k1", "k2", "text").join(starts, ["k1", "k2"]), window), "cut", small=True, compression="zstd")
    ws.drop("texts", "starts")
    return cut


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, batches: int = 2) -> Repeats:
    """Finds the words under windows whose word sequence starts anywhere else too, same row included.

    The rows enter a fingerprint log of their own in ``batches`` batches, by a hash of their text; the log is merged as
    it grows and deleted at the end (``PassageIndex`` keeps it).  Null texts have no words; texts of fewer words than a
    window lose none; repeated rows are copies of each other; null ids and further columns change nothing; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "substring")
    ws.tidy()  # what earlier steps have left
    marks = ws.table(_marked(docs, id_col, text_col, window), "marks", small=True, compression="zstd")
    log, hits = FingerprintLog(spark, f"{ws.path}/index"), None
    for k in range(batches):
        new = log.add(marks.filter(F.pmod("k1", F.lit(batches)) == k).select(F.explode("anchors").alias("hash")), ws)
        hits = new if hits is None else hits.union(new)
    log.close()
    ws.drop("index")
    cut = _verified(ws, marks.withColumn("own", F.lit(True)), _first_copies(docs, text_col), hits.distinct(), window)
    return Repeats(marks.drop("anchors"), cut)


class PassageIndex:
    """Incremental removal of repeats: a kept fingerprint log, and the texts it was made of, in one folder.

    ``add`` judges a batch against everything added before and against itself, then files it; earlier batches stay as
    they were given out.  A batch whose ``add`` broke off can be added again.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = 35, buckets: int | None = None):
        self.spark, self.path, self.window = spark, path.rstrip("/"), window
        self.log = FingerprintLog(spark, f"{self.path}/log", buckets)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Repeats:
        """The batch's words under windows that start elsewhere in it or in an earlier batch; edge cases as in ``find_repeats``."""
        ws, n = Workspace(self.spark, "passages"), self.log.batches
        marks = ws.table(_marked(docs, id_col, text_col, self.window), "marks", small=True, compression="zstd")
        marks.select("k1", "k2", "n_words", "anchors").write.mode("overwrite").parquet(f"{self.path}/marks/batch={n}")
        _first_copies(docs, text_col).write.mode("overwrite").parquet(f"{self.path}/texts/batch={n}")
        hits = self.log.add(marks.select(F.explode("anchors").alias("hash")), ws)
        every = self.spark.read.schema("k1 long, k2 long, n_words long, anchors array<long>, batch int").parquet(f"{self.path}/marks").filter(F.col("batch") <= n)
        texts = self.spark.read.schema("k1 long, k2 long, text binary, batch int").parquet(f"{self.path}/texts").filter(F.col("batch") <= n).drop("batch")
        cut = _verified(ws, every.withColumn("own", F.col("batch") == n), texts, hits, self.window)
        return Repeats(marks.drop("anchors"), cut)

    def close(self) -> None:
        self.log.close()


def removal_report(found: Repeats) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256)``, one row per input row."""
    cut = found.cut.select("k1", "k2", "n_removed", F.sha2("kept", 256).alias("kept_sha"))
    return found.marks.join(cut, ["k1", "k2"], "left").select("id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, text_col: str = "text", window: int = 35, batches: int = 2) -> DataFrame:
    """The input with the repeated words taken out of ``text_col``; texts that lose none stay as they are.

    Edge cases as in ``find_repeats``: every row stays, null texts stay null, and columns of any names pass through.
    """
    k1, k2, kept = fresh(docs, "k1", "k2", "kept")
    found = find_repeats(docs.select(F.lit(0).alias("row"), F.col(f"`{text_col}`").alias("text")), "row", "text", window, batches)
    text = F.col(f"`{text_col}`").cast("binary")
    cut = found.cut.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("kept").cast("string").alias(kept))
    keyed = docs.withColumns({k1: F.xxhash64(F.lit(1), text), k2: F.xxhash64(F.lit(2), text)})
    return keyed.join(cut, [k1, k2], "left").withColumn(text_col, F.coalesce(kept, f"`{text_col}`")).select(*[F.col(f"`{c}`") for c in docs.columns])
