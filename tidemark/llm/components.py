"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two joins whose result is written to the shared folder; neither edges nor
labels ever reach the driver, only a count and a checksum of each round.  Hubs are aggregated before the shuffle
and meet their edges in an ordinary join, which adaptive execution splits when one hub holds many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("lo")).select("a", F.least("a", "lo").alias("lo"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("lo").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    low = down.groupBy("a").agg(F.min("b").alias("lo"))
    moved = down.join(low, "a").filter("b <> lo").select(F.col("b").alias("a"), F.col("lo").alias("b"))
    return moved.union(low.select("a", F.col("lo").alias("b"))).distinct()


def connected_components(edges: DataFrame, ws: Workspace, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)`` for each node that has an edge, root being the smallest node.

    Self loops and repeated edges are harmless; an empty table gives an empty result.
    """
    now = ws.table(edges.filter("a <> b").select("a", "b").distinct(), "cc-0")
    seen = None
    for k in range(1, max_rounds + 1):
        now = ws.table(_small_star(_large_star(now)), f"cc-{k}")
        if k > 1:
            ws.drop(f"cc-{k - 1}")
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
