import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import context, fulltext, fusion, rerank, vector_search
from tidemark.plans.engine import Engine

LANE = "query_id long, lane string, frame_id long, score double, preview string"


def lanes(spark, *rows):
    return spark.createDataFrame([(1, lane, i, float(s), None) for lane, i, s in rows], LANE)


def order(df):
    return [r.frame_id for r in sorted(df.collect(), key=lambda r: r["rank"])]


def test_fusion_of_two_lanes(spark):
    two = lanes(spark, ("text", 10, 4), ("text", 20, 2), ("vector", 20, 3), ("vector", 30, 1))
    got = fusion.weighted_rrf(two).collect()
    assert order(fusion.weighted_rrf(two))[0] == 20 and len(got) == 3
    assert {r.frame_id: r.sources for r in got}[20] == ["text", "vector"]
    twice = lanes(spark, ("text", 100, 4), ("text", 100, 3), ("vector", 50, 5))
    assert order(fusion.weighted_rrf(twice))[0] == 50


@pytest.mark.parametrize(("alpha", "frames"), [(-1.0, [30]), (2.0, [10]), (float("nan"), [30])])
def test_alpha_is_held_in_bounds(spark, alpha, frames):
    assert order(fusion.weighted_rrf(lanes(spark, ("text", 10, 1), ("vector", 30, 1)), alpha=alpha)) == frames


@pytest.mark.parametrize("k", [0, -7])
def test_rrf_k_below_zero_counts_as_zero(spark, k):
    assert fusion.weighted_rrf(lanes(spark, ("text", 1, 3)), alpha=1.0, rrf_k=k).first().score == 1.0


def test_nan_scores_and_ties(spark):
    rows = lanes(spark, ("text", 5, 1), ("text", 2, 1), ("text", 1, 3), ("text", 9, float("nan")))
    merged = fusion.top_k(fusion.merge_duplicates(rows), ["query_id"], [F.desc("score"), F.asc("frame_id")], 2)
    assert order(merged) == [1, 2]


def test_bm25_orders_and_lower_ids_win_ties(spark):
    frames = spark.createDataFrame([(10, "apple banana"), (11, "apple apple"), (12, "Banana!!"), (13, None), (14, "kiwi"), (15, "pear"), (16, "pear plum"), (17, "fig")], "frame_id long, text string")
    queries = spark.createDataFrame([(1, "apple banana"), (2, ""), (3, "the of"), (4, "BANANA banana")], "query_id long, query string")
    got = fulltext.bm25_search(frames, queries).collect()
    assert [r.frame_id for r in got if r.query_id == 1][:1] == [10] and {r.query_id for r in got} == {1, 4}
    shuffled = fulltext.bm25_search(frames.orderBy(F.desc("frame_id")).repartition(3), queries)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, got))


def test_token_budget(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, "one two three"), (1, 2, 1.0, "four five six"), (1, 3, 0.5, "four five six")], "query_id long, frame_id long, score double, preview string")
    got = sorted(context.build_context(rows, expansion=2, snippet=2, context=3).collect(), key=lambda r: r.position)
    assert [(r.text, r.tokens, r.kind) for r in got] == [("one two", 2, "expanded"), ("four", 1, "snippet")]
    assert [r.kind for r in context.build_context(rows, expansion=0, max_snippets=1).collect()] == ["snippet"]


def test_reranking_prefers_what_is_asked_for(spark):
    schema = "query_id long, rank int, frame_id long, score double, preview string, sources array<string>"
    texts = ["Draft memo: atlas10 public launch target date is tentative", "For atlas10, public launch is January 5, 2026.", "weekly report"]
    rows = spark.createDataFrame([(q, n + 1, n, 1.0 - n / 10, p, ["text"]) for q in (1, 2) for n, p in enumerate(texts)], schema)
    queries = spark.createDataFrame([(1, "when is the launch of atlas10"), (2, "nothing of that")], "query_id long, query string")
    got = rerank.intent_rerank(rows, queries).collect()
    assert order(_of(spark, got, 1))[0] == 1 and order(_of(spark, got, 2)) == [0, 1, 2]
    assert {r.frame_id: r.score for r in got if r.query_id == 1} == {0: 1.0, 1: 0.9, 2: 0.8}


def _of(spark, rows, q):
    return spark.createDataFrame([(r["rank"], r.frame_id) for r in rows if r.query_id == q], "rank int, frame_id long")


def test_knn_blocks_lengths_and_metrics(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 5)).round(3)
    x[7] = 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "frame_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(9)], "query_id long, embedding array<double>")
    for metric in vector_search.METRICS:
        one = sorted(map(str, vector_search.knn_exact(vectors, asked, metric, 3).collect()))
        assert one == sorted(map(str, vector_search.knn_exact(vectors, asked, metric, 3, block=2).collect()))
    with pytest.raises(Exception, match="differ in length"):
        vector_search.knn_exact(vectors, spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")).collect()


def test_recall_end_to_end(spark):
    frames = spark.createDataFrame([(0, 0, 0, None, "Mira owns deployment readiness for atlas10."), (1, 0, 0, None, "The public launch of atlas10 is January 5, 2026."), (2, 0, 1, None, "deleted atlas10 owner")], "frame_id long, ts_ms long, status int, superseded_by long, text string")
    queries = spark.createDataFrame([(1, "who owns atlas10 and when is the launch")], "query_id long, query string")
    items, answers = Engine(spark).recall(frames, queries)
    assert {r.frame_id for r in items.collect()} == {0, 1}
    assert answers.first().answer == "Mira and January 5, 2026"


def test_byte_pair_encoding_round_trip(spark):
    import public_tokenizers

    from tidemark.operators import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = spark.createDataFrame([("Hello, wörld! 12345\n\n  x",), ("",), (None,)], "text string")
    got = rows.select("text", bpe.decode(bpe.encode(F.col("text"), path), path).alias("back"), bpe.truncate(F.col("text"), 2, path).alias("cut")).collect()
    assert all(r.text == r.back for r in got) and got[0].cut == "Hello,"


def test_citation_rates(spark):
    from tidemark.operators.evaluate import citation_rates

    pack = spark.createDataFrame([(1, ["a/"]), (2, ["b/"]), (3, [])], "query_id long, must_cite array<string>")
    cited = spark.createDataFrame([(1, "x/a/c.h"), (2, "x/c.h")], "query_id long, path string")
    r = citation_rates(pack, cited).first()
    assert r.queries == 3 and round(r.influence_rate, 3) == 0.667 and round(r.required_path_rate, 3) == 0.333
