"""What several operators need."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table of keys is broadcast only if it has been counted and holds at most so many rows.
BROADCAST_ROWS = 200_000


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if counting finds it small; a plain join serves beyond that."""
    return F.broadcast(table) if len(table.limit(rows + 1).select(F.lit(1)).groupBy().count().filter(F.col("count") <= rows).take(1)) else table


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts the groups before the shuffle too.  k <= 0 keeps all."""
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k) if k > 0 else ranked


def made_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """The rows with columns that are computed here and not again wherever they are used, lambdas included."""
    return rows.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")).select("*", "_made.*").drop("_made")


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's checkpoints, which driver and executors share; only a local master may do without one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='tidemark-')}")
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, so that what follows neither makes them again nor carries their plan."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()
