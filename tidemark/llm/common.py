"""Shared plumbing: intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Has Spark delete a write's shuffle files as soon as the write is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROWS, _OCTETS = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Only a local master may do without: it then gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a folder through Hadoop's file system, so any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as ``__``) that hold inside the block and are put back after it."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _batch_limits(spark: SparkSession, rows: int = 2_000, octets: int = 8 << 20) -> dict[str, str]:
    """Limits for Arrow batches, so that neither side of a Python worker holds large ones; never higher than the session's."""
    out = {}
    for key, most in ((_ROWS, rows), (_OCTETS, octets)):
        now = int(str(spark.conf.get(key)).rstrip("b"))
        if now <= 0 or now > most:
            out[key] = str(most)
    return out


_LENT: list[tuple[object, SparkSession, str]] = []  # (weak reference to what plans of a table hold, session, path)


def sweep() -> None:
    """Deletes written tables that no plan in the driver reads any more."""
    kept = []
    for ref, spark, path in _LENT:
        try:
            if ref.get() is None:
                delete_path(spark, path)
            else:
                kept.append((ref, spark, path))
        except Exception:  # noqa: BLE001  a session that has ended
            pass
    _LENT[:] = kept


_SCOPES: list[list[Workspace]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Workspaces opened in the block are deleted at its end; results must be written by then."""
    made: list[Workspace] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for ws in made:
            ws.close()


class Workspace:
    """A folder of written tables that cut lineage.

    A table goes by ``drop()``, or once no plan reads it, or with ``close()``, at the latest with the driver's process.
    """

    def __init__(self, spark: SparkSession, name: str):
        sweep()
        self.spark, self.path = spark, f"{shared_root(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)
        if _SCOPES:
            _SCOPES[-1].append(self)

    def table(self, df: DataFrame, name: str, small: bool = False, **options: str) -> DataFrame:
        """Writes the rows as Parquet and returns a plan that only reads them; ``small`` bounds the Arrow batches."""
        path = f"{self.path}/{name}"
        held = {_CLEANUP: "true", **(_batch_limits(self.spark) if small else {})}
        with settings(self.spark, **held):
            df.write.mode("overwrite").options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        _LENT.append((self.spark._jvm.java.lang.ref.WeakReference(out._jdf.queryExecution().analyzed().relation().location()), self.spark, path))
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            path = f"{self.path}/{name}"
            _LENT[:] = [x for x in _LENT if x[2] != path]
            delete_path(self.spark, path)

    def tidy(self) -> None:
        """Lets go of plans and tables that nothing holds any more, those of earlier steps included."""
        gc.collect()
        self.spark._jvm.System.gc()
        sweep()

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            _LENT[:] = [x for x in _LENT if not x[2].startswith(f"{self.path}/")]
            delete_path(self.spark, self.path)
        except Exception:  # noqa: BLE001  the session may be gone at exit; leftovers are harmless
            pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column."""
    known = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
