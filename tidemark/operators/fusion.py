"""Result lanes: filters, merging, reciprocal rank fusion and its adaptive weights.

A lane table is ``(query_id, lane, frame_id, score, preview)``; lanes are ``text``, ``vector`` or any further ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import query_class
from tidemark.operators.common import top_k

#: Weight of the text lane by class of query; the vector lane has the rest.
TEXT_WEIGHT = {"factual": 0.7, "semantic": 0.3, "temporal": 0.25, "exploratory": 0.4}


def finite(score: Column) -> Column:
    return F.when(F.isnan(score), 0.0).otherwise(score)


def filter_frames(
    hits: DataFrame, frames: DataFrame, ids: DataFrame | None = None, surrogates: DataFrame | None = None, after_ms: int | None = None, before_ms: int | None = None,
    metadata: dict[str, str] | None = None, tags: list[tuple[str, str]] | None = None, labels: list[str] | None = None, deleted: bool = False, superseded: bool = False,
) -> DataFrame:
    """Hits whose frame is active, current and as asked; the time range is half open.

    Given after the top k it may leave fewer than k rows; given ``frames`` themselves as hits it filters beforehand.
    """
    good = frames
    if not deleted:
        good = good.filter("status = 0")
    if not superseded:
        good = good.filter("superseded_by is null")
    if after_ms is not None:
        good = good.filter(F.col("ts_ms") >= after_ms)
    if before_ms is not None:
        good = good.filter(F.col("ts_ms") < before_ms)
    for k, v in (metadata or {}).items():
        good = good.filter(F.col("metadata")[k] == v)
    for k, v in tags or []:
        good = good.filter(F.exists("tags", lambda t: (t["k"] == k) & (t["v"] == v)))  # noqa: B023
    if labels:
        good = good.filter(F.size(F.array_except(F.array(*map(F.lit, labels)), "labels")) == 0)
    if ids is not None:
        good = good.join(ids.select("frame_id").distinct(), "frame_id", "left_semi")
    if surrogates is not None:
        good = good.join(surrogates.select("frame_id").distinct(), "frame_id", "left_anti")
    return hits.join(good.select("frame_id"), "frame_id", "left_semi")


def merge_duplicates(lanes: DataFrame, by: tuple[str, ...] = ("query_id", "frame_id")) -> DataFrame:
    """One row per frame: best score (NaN is 0), the smallest preview among the best rows or else among all, all lanes."""
    rows = lanes.withColumn("score", finite(F.col("score")))
    best = rows.withColumn("top", F.max("score").over(Window.partitionBy(*by)))
    return best.groupBy(*by).agg(
        F.max("score").alias("score"),
        F.coalesce(F.min(F.when(F.col("score") == F.col("top"), F.col("preview"))), F.min("preview")).alias("preview"),
        F.array_sort(F.collect_set("lane")).alias("sources"),
    )


def weighted_rrf(lanes: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, rrf_k: int = 60, k: int = 10, digits: int = 9) -> DataFrame:
    """Fuses lanes by w / (max(0, rrf_k) + rank), ranks counted from 1 within each lane's first k.

    ``weights(query_id, alpha)`` gives each query's weight of the text lane, else ``alpha`` does; the other lanes have the
    rest, lanes of weight 0 are left out, and alpha is held in 0 .. 1 with NaN as 0.  Previews of the text lane come first.
    """
    merged = merge_duplicates(lanes, ("query_id", "lane", "frame_id")).drop("sources")
    ranked = top_k(merged, ["query_id", "lane"], [F.desc("score"), F.asc("frame_id")], k)
    rows = ranked.join(weights, "query_id") if weights is not None else ranked.withColumn("alpha", F.lit(float(alpha)))
    held = F.when(F.isnan("alpha"), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("alpha"))))
    rows = rows.withColumn("w", F.when(F.col("lane") == "text", held).otherwise(1 - held)).filter("w > 0")
    fused = rows.groupBy("query_id", "frame_id").agg(
        F.round(F.sum(F.col("w") / (max(0, rrf_k) + F.col("rank"))), digits).alias("score"),
        F.coalesce(F.min(F.when(F.col("lane") == "text", F.col("preview"))), F.min("preview")).alias("preview"),
        F.array_sort(F.collect_set("lane")).alias("sources"),
    )
    return top_k(fused, ["query_id"], [F.desc("score"), F.asc("frame_id")], k)


def rank_diagnostics(lanes: DataFrame, k: int = 10) -> DataFrame:
    """For each frame of a query, its rank and score in every lane."""
    ranked = top_k(merge_duplicates(lanes, ("query_id", "lane", "frame_id")).drop("sources"), ["query_id", "lane"], [F.desc("score"), F.asc("frame_id")], k)
    return ranked.groupBy("query_id", "frame_id").agg(F.array_sort(F.collect_list(F.struct("lane", "rank", "score"))).alias("lanes"))


def adaptive_weights(queries: DataFrame) -> DataFrame:
    """``(query_id, class, alpha)`` by the class of each query."""
    kind = query_class(F.col("query"))
    weight = F.lit(0.5)
    for name, w in TEXT_WEIGHT.items():
        weight = F.when(kind == name, w).otherwise(weight)
    return queries.select("query_id", kind.alias("class"), weight.alias("alpha"))


def timeline_lane(frames: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The newest active frames as a lane of their own, the same for each query; k rows are cut before they meet the queries."""
    newest = frames.filter("status = 0").orderBy(F.desc("ts_ms"), F.asc("frame_id")).limit(k)
    return queries.select("query_id").crossJoin(F.broadcast(newest)).select("query_id", F.lit("timeline").alias("lane"), "frame_id", F.col("ts_ms").cast("double").alias("score"), F.col("text").alias("preview"))


def blend_scores(text: DataFrame, vector: DataFrame, text_weight: float = 0.3, k: int = 10, digits: int = 8) -> DataFrame:
    """Weighted sum of BM25 and (1 + cosine) / 2, a missing one counting 0."""
    both = text.select("query_id", "frame_id", (F.col("score") * text_weight).alias("s")).union(vector.select("query_id", "frame_id", ((1 + F.col("score")) / 2 * (1 - text_weight)).alias("s")))
    summed = both.groupBy("query_id", "frame_id").agg(F.round(F.sum("s"), digits).alias("score"))
    return top_k(summed, ["query_id"], [F.desc("score"), F.asc("frame_id")], k).select("query_id", "rank", "frame_id", "score")


def drop_repeated_text(rows: DataFrame, text: str = "preview", order: str = "rank") -> DataFrame:
    """Of rows of a query with one text, the first."""
    seen = Window.partitionBy("query_id", F.sha2(F.col(text).cast("binary"), 256)).orderBy(order)
    return rows.withColumn("_seen", F.row_number().over(seen)).filter("_seen = 1").drop("_seen")
