"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking.

The trees are fitted on a bounded sample; every row is then filed under its leaf in each of them.  A query descends
all trees through a single priority queue, the likeliest regions first: each hyperplane on the way costs the negative
logarithm of the chance that a near neighbour lies on that side, given the query's distance from it and how far near
neighbours in the sample spread across it.  It opens leaves until they hold its budget of rows, a row counting in each
tree.  Leaves compare their rows with the queries that opened them, several leaves at a time, in blocks of bounded size,
by the exact distance of the original vectors, and send on at most ``k`` rows for each query.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace

_GRID = np.linspace(-37, 8, 4501)
_COST = -np.log(np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in _GRID]))


class Forest:
    """Trees as flat arrays: each inner node has a hyperplane, two children and the spread of near neighbours across it."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 5):
        self.normal, self.offset, self.low, self.high, self.roots, self.leaves, self.tree = [], [], [], [], [], 0, []
        rng = np.random.default_rng(seed)
        for t in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), leaf, rng))
            self.tree += [t] * (self.leaves - len(self.tree))
        self.normal = np.array(self.normal).reshape(len(self.offset), sample.shape[1])
        self.offset, self.low, self.high = np.array(self.offset), np.array(self.low, np.int64), np.array(self.high, np.int64)
        near = self._displacements(sample, rng)
        self.spread = np.maximum(np.sqrt(((near @ self.normal.T) ** 2).mean(axis=0)), 1e-12) if len(near) else np.ones(len(self.offset))

    @staticmethod
    def _displacements(sample: np.ndarray, rng: np.random.Generator, rows: int = 256, k: int = 10) -> np.ndarray:
        """From some rows of the sample to the nearest others."""
        picked = sample[rng.choice(len(sample), min(rows, len(sample)), replace=False)]
        rough = (sample * sample).sum(axis=1)[None, :] - 2 * picked @ sample.T
        k = min(k + 1, len(sample))
        near = np.argpartition(rough, k - 1, axis=1)[:, :k]
        return (sample[near] - picked[:, None, :]).reshape(-1, sample.shape[1])

    def _grow(self, x: np.ndarray, at: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        """The number of the node that was made; a leaf's is ``-1 - leaf``."""
        if len(at) > leaf:
            for _ in range(8):
                a, b = rng.choice(at, 2, replace=False)
                normal = x[a] - x[b]
                if (length := np.linalg.norm(normal)) > 0:
                    place = x[at] @ (normal / length)
                    cut = float(np.median(place))
                    down = place <= cut
                    if 0 < down.sum() < len(at):
                        node = len(self.offset)
                        self.normal.append(normal / length)
                        self.offset.append(cut)
                        self.low.append(0)
                        self.high.append(0)
                        self.low[node] = self._grow(x, at[down], leaf, rng)
                        self.high[node] = self._grow(x, at[~down], leaf, rng)
                        return node
        self.leaves += 1
        return -self.leaves

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree: ``(n, trees)``."""
        out = np.zeros((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root, np.int64)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                up = np.einsum("ij,ij->i", x[inner], self.normal[node]) > self.offset[node]
                at[inner] = np.where(up, self.high[node], self.low[node])
            out[:, t] = -1 - at
        return out

    def search(self, x: np.ndarray, sizes: np.ndarray, budget: float, least: int) -> list[int]:
        """Leaves in the order in which the queue opens them, until they hold ``budget`` rows and one tree's hold ``least``."""
        margin = (self.normal @ x - self.offset) / self.spread if len(self.offset) else np.zeros(0)
        down, up = np.interp(-margin, _GRID, _COST).tolist(), np.interp(margin, _GRID, _COST).tolist()
        low, high, push, pop = self.low.tolist(), self.high.tolist(), heapq.heappush, heapq.heappop
        queue, opened, held, of_tree = [(0.0, root) for root in self.roots], [], 0, [0] * len(self.roots)
        heapq.heapify(queue)
        while queue and (held < budget or max(of_tree) < least):
            cost, node = pop(queue)
            if node >= 0:
                push(queue, (cost + down[node], low[node]))
                push(queue, (cost + up[node], high[node]))
            else:
                n = int(sizes[-1 - node])
                opened.append(-1 - node)
                held += n
                of_tree[self.tree[-1 - node]] += n
        return opened


def usable(vector: Column, dim: int) -> Column:
    """True for vectors of ``dim`` finite components, not all of them zero."""
    fine = ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def row_budget(rows: int, effort: float) -> float:
    """How many rows the leaves that a query opens hold together: ``effort * rows ** 0.74``.

    At a given effort recall stays about level as a table grows, since near neighbours get nearer than others.
    """
    return effort * rows**0.74


def _compare(x: np.ndarray, x_id: np.ndarray, q: np.ndarray, q_id: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries, rows and exact distances of each query's ``k`` nearest of these rows, ties included, its own row left out."""
    out, squares, step = [], np.einsum("ij,ij->i", x, x), max(1, (1 << 20) // max(1, len(x)))
    for s in range(0, len(q), step):
        part = q[s : s + step]
        rough = squares[None, :] - 2 * (part @ x.T)
        rough[x_id[None, :] == q_id[s : s + step, None]] = np.inf
        if len(x) > k:
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
            near = rough <= (kth + 1e-9 * (1 + np.abs(kth) + np.einsum("ij,ij->i", part, part)))[:, None]
        else:
            near = np.ones(rough.shape, bool)
        a, b = np.nonzero(near & np.isfinite(rough))
        out.append((q_id[s + a], x_id[b], np.sqrt(((x[b] - part[a]) ** 2).sum(axis=1))))
    return out


def _first(asker: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's ``k`` nearest, ties to the smaller id, an id once."""
    order = np.lexsort((found, score, asker))
    pair = np.stack([asker[order], found[order]])
    _, once = np.unique(pair, axis=1, return_index=True)
    order = order[np.sort(once)]
    own = asker[order]
    new = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
    rank = np.arange(len(own)) - np.repeat(new, np.diff(new, append=len(own)))
    return order[rank < k]


def search(table: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, trees: int = 12, leaf: int = 32, sample: int = 20_000, effort: float = 6.0, block: int = 8_192) -> DataFrame:
    """``(query_id, rank, id, score)``: each query's ``k`` nearest found, by Euclidean distance, ties to the smaller id.

    Queries are the rows for which ``queries`` is true.  Vectors that are null, zero, of another length than most, or
    that hold null or non-finite components take no part, nor do rows with a null id; of rows with one id that with the
    smallest vector counts.  A query with fewer candidates gets them all; an empty table gives no rows; further columns
    are ignored.  ``effort`` sets how many rows a query opens (``row_budget``).
    """
    spark = table.sparkSession
    ws = Workspace(spark, "neighbours")
    single = dict(table.dtypes)[vector_col] == "array<float>"
    raw_type = np.dtype("<f4" if single else "<f8")
    base = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter("id is not null")
    common = base.filter(F.size("v") > 0).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, id long, score double"
    if not common:
        return spark.createDataFrame([], schema)
    dim = common["dim"]
    rows = ws.table(base.filter(usable(F.col("v"), dim)).groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")), "rows", compression="zstd")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], schema)
    pick = rows.filter(F.xxhash64(F.lit(3), "id") / F.lit(2.0**64) + F.lit(0.5) <= min(1.0, 1.5 * sample / total)).select("id", "v")
    fitted = np.array([r["v"] for r in pick.orderBy(F.xxhash64(F.lit(4), "id"), "id").limit(sample).collect()]).reshape(-1, dim)
    if not len(fitted):
        fitted = np.zeros((1, dim))
    shared = spark.sparkContext.broadcast(Forest(fitted, trees, leaf))  # bounded by the sample
    leaves = shared.value.leaves

    def file(batches):
        forest = shared.value
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(-1, dim)
            where = forest.file(x)
            raw = pa.array([v.tobytes() for v in x.astype(raw_type)], pa.binary())
            for t in range(where.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(where[:, t]), batch.column(0), raw], names=["leaf", "id", "v"])

    filed = ws.table(rows.select("id", "v").mapInArrow(file, "leaf long, id long, v binary"), "filed", small=True, compression="zstd")
    sizes = np.zeros(leaves, np.int64)
    for r in filed.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # as many as the forest has leaves
        sizes[r["leaf"]] = r["n"]
    budget = row_budget(total, effort)

    def ask(batches):
        forest = shared.value
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(-1, dim)
            for q, key in zip(x, batch.column(0).to_pylist(), strict=True):
                opened = forest.search(q, sizes, budget, k + 1)
                raw = q.astype(raw_type).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(opened, pa.int64()), pa.array([key] * len(opened), pa.int64()), pa.array([raw] * len(opened), pa.binary())], names=["leaf", "id", "v"])

    asked = ws.table(rows.filter("asks").select("id", "v").mapInArrow(ask, "leaf long, id long, v binary"), "asked", small=True, compression="zstd")
    asking = np.zeros(leaves, np.int64)
    for r in asked.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        asking[r["leaf"]] = r["n"]
    # neighbouring leaves travel together, up to a block of rows and of queries; a larger leaf is alone and cut into blocks
    pack, rows_in, asks_in = np.zeros(leaves, np.int64), [0], [0]
    for n in range(leaves):
        if rows_in[-1] and (rows_in[-1] + sizes[n] > block or asks_in[-1] + asking[n] > block):
            rows_in.append(0)
            asks_in.append(0)
        pack[n] = len(rows_in) - 1
        rows_in[-1] += int(sizes[n])
        asks_in[-1] += int(asking[n])
    plan = [(n, int(p), max(1, -(-rows_in[p] // block)), max(1, -(-asks_in[p] // block))) for n, p in enumerate(pack)]  # a row for each leaf of the forest
    placed = lambda t: t.join(F.broadcast(spark.createDataFrame(plan, "leaf long, pack long, row_parts int, ask_parts int")), "leaf")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("bigint")).cast("int")
    left = placed(filed).select("pack", "leaf", "id", "v", own("row_parts").alias("r"), each("ask_parts").alias("a"))
    right = placed(asked).select("pack", "leaf", "id", "v", own("ask_parts").alias("a"), each("row_parts").alias("r"))

    def compare(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            rows, asks = rows.sort_values("leaf", kind="stable"), asks.sort_values("leaf", kind="stable")
            x, q = (np.frombuffer(b"".join(t["v"]), raw_type).reshape(-1, dim).astype(float) for t in (rows, asks))
            x_id, q_id, x_leaf, q_leaf = rows["id"].to_numpy(), asks["id"].to_numpy(), rows["leaf"].to_numpy(), asks["leaf"].to_numpy()
            for n in np.unique(q_leaf):
                a, b = np.searchsorted(x_leaf, [n, n + 1])
                c, d = np.searchsorted(q_leaf, [n, n + 1])
                if b > a:
                    out += _compare(x[a:b], x_id[a:b], q[c:d], q_id[c:d], k)
        if not out:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        asker, found, score = (np.concatenate(c) for c in zip(*out, strict=True))
        best = _first(asker, found, score, k) if len(asker) else slice(0)
        return pd.DataFrame({"query_id": asker[best], "id": found[best], "score": score[best]})

    keys = ["pack", "r", "a"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, id long, score double")
    once = near.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
