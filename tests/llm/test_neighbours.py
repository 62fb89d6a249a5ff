import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemark.llm import neighbours
from tidemark.llm.queries import QUERIES


def brute(rows, k=10):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, q in good:
        if i % 100 == 0:
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = found(QUERIES["op9_forest_neighbours"](spark, "/root/testdata/sf0.1"))
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert sum(hits) / len(hits) >= 0.9
    assert all(abs(dict(want[q]).get(i, d) - d) < 1e-12 for q in want for i, d in got[q])


def test_recall_and_work_on_fifty_thousand_rows_without_direction(spark, tmp_path):
    """All queries against all rows, evenly spread over the sphere in 64 dimensions, where neighbours are hardest to find."""
    x = np.random.default_rng(8).standard_normal((50_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}), f"{tmp_path}/embeddings.parquet")
    got = found(QUERIES["op9_forest_neighbours"](spark, str(tmp_path)))
    x = x.astype(float)
    hits = 0
    for q in range(0, len(x), 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argpartition(d, 10)[:10].tolist()) & {i for i, _ in got[q]})
    assert hits / (10 * len(got)) >= 0.9
    assert neighbours.row_budget(50_000, 6.0) < 0.4 * 50_000 and neighbours.row_budget(10**9, 6.0) < 0.03 * 10**9


def test_repeated_ids_count_once_and_the_sample_is_bounded(spark):
    rows = [(7, [1.0, 0.0])] * 300 + [(7, [0.0, 1.0]), (8, [0.9, 0.1]), (100, [1.0, 0.01])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(table, F.col("vec_id") == 100, sample=20).orderBy("rank").collect()
    assert [(r["rank"], r.id) for r in got] == [(1, 8), (2, 7)] and abs(got[1].score - math.hypot(1.0, 0.99)) < 1e-12


def test_ties_copies_and_odd_vectors(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(0, 900, 2)] + [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(1, 900, 2)]
    odd = [(1000, None), (1100, [0.0, 0.0, 0.0]), (1200, [1.0, None, 0.0]), (1300, [1.0, math.nan, 0.0]), (1400, [math.inf, 1.0, 1.0]), (1500, []), (None, [1.0, 1.0, 1.0])]
    spark.createDataFrame([(*r, 0) for r in rows + odd], "vec_id long, embedding array<float>, leaf int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = found(QUERIES["op9_forest_neighbours"](spark, str(tmp_path))), brute([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows + odd])
    assert got == want


def test_few_candidates_small_blocks_and_empty_table(spark):
    rows = [(i * 50, [float(i), 1.0]) for i in range(5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for options in ({}, {"block": 2, "leaf": 1, "trees": 2, "effort": 50.0}):
        got = neighbours.search(table, F.col("vec_id") % 100 == 0, **options).collect()
        assert sorted((r.query_id, r["rank"], r.id) for r in got) == sorted((q, n + 1, i) for q, v in brute(rows).items() for n, (i, _) in enumerate(v))
    assert neighbours.search(table.limit(0), F.lit(True)).count() == 0
