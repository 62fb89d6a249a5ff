"""Full-text search over a table of frames for a table of queries: BM25, TF-IDF and several weighted fields."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import SEARCH_STOP_WORDS, ascii_lower
from tidemark.operators.common import checkpointed, small, top_k


def ascii_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), ascii_lower)


def unicode_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def drop_stop_words(tokens: Column) -> Column:
    """The tokens without stop words, or all of them if none is left."""
    kept = F.filter(tokens, lambda t: ~t.isin(SEARCH_STOP_WORDS))
    return F.when(F.size(kept) == 0, tokens).otherwise(kept)


def query_tokens(queries: DataFrame) -> DataFrame:
    """``(query_id, token, times)``: the search tokens of each query and how often it holds them."""
    exploded = queries.select("query_id", F.explode(drop_stop_words(ascii_tokens(F.col("query")))).alias("token"))
    return exploded.groupBy("query_id", "token").agg(F.count("*").alias("times"))


def postings(frames: DataFrame, tokenizer: Callable[[Column], Column], wanted: DataFrame | None = None) -> DataFrame:
    """``(frame_id, length, token, tf)``; with ``wanted(token)`` only of these tokens, dropped before any shuffle if few."""
    rows = frames.select("frame_id", tokenizer(F.col("text")).alias("tokens")).select("frame_id", F.size("tokens").alias("length"), "tokens")
    rows = rows.select("frame_id", "length", F.explode("tokens").alias("token"))  # the length is there by now, so no row carries the whole text's tokens
    if wanted is not None:
        rows = rows.join(small(wanted), "token", "left_semi")
    return rows.groupBy("frame_id", "length", "token").agg(F.count("*").alias("tf"))


def corpus_size(frames: DataFrame, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """One row: how many frames there are and their mean length in tokens."""
    return frames.agg(F.count("*").alias("n"), F.avg(F.size(tokenizer(F.col("text")))).alias("mean_length"))


def document_frequency(frames: DataFrame, tokenizer: Callable[[Column], Column] = ascii_tokens) -> DataFrame:
    return frames.select(F.explode(F.array_distinct(tokenizer(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def bm25_scores(frames: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(query_id, frame_id, score)`` of all frames that share a token with the query; repeats in a query count once."""
    asked = query_tokens(queries).select("query_id", "token")
    found = checkpointed(postings(frames, unicode_tokens, asked.select("token").distinct()))  # made once, read for df and for scores
    weight = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = found.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus_size(frames, unicode_tokens))).withColumn("idf", F.when(weight <= 0, 1e-6).otherwise(weight))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    return found.join(df, "token").withColumn("part", part).join(small(asked), "token").groupBy("query_id", "frame_id").agg(F.sum("part").alias("score"))


def tfidf_scores(frames: DataFrame, queries: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(query_id, frame_id, score)``, each token as often as the query holds it; of ``pairs(query_id, frame_id)`` only, if given."""
    asked = query_tokens(queries)
    found = checkpointed(postings(frames, ascii_tokens, asked.select("token").distinct()))
    df = found.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(frames.agg(F.count("*").alias("n"))))
    part = F.col("tf") * (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    weighed = found.join(df, "token").withColumn("part", part)
    met = weighed.join(small(asked), "token") if pairs is None else pairs.join(small(asked), "query_id").join(weighed, ["frame_id", "token"])
    return met.groupBy("query_id", "frame_id").agg(F.sum(F.col("part") * F.col("times")).alias("score"))


def best(scores: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """The k best frames of each query by rounded score, ties to the smaller id."""
    rounded = scores.withColumn("score", F.round("score", digits)).filter("score > 0")
    return top_k(rounded, ["query_id"], [F.desc("score"), F.asc("frame_id")], max(1, k)).select("query_id", "rank", "frame_id", "score")


def bm25_search(frames: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    return best(bm25_scores(frames, queries), k)


def tfidf_search(frames: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    return best(tfidf_scores(frames, queries), k)


def rescored_search(frames: DataFrame, queries: DataFrame, candidates: int = 100, k: int = 10) -> DataFrame:
    """TF-IDF over the best BM25 candidates only."""
    first = bm25_search(frames, queries, candidates).select("query_id", "frame_id")
    return best(tfidf_scores(frames, queries, first), k)


def best_field_scores(frames: DataFrame, queries: DataFrame, text_fields: dict[str, float], keyword_fields: dict[str, float] | None = None) -> DataFrame:
    """``(query_id, frame_id, score)``: the greatest of the weighted field scores.

    Text fields are scored by BM25 over that field alone; a keyword field scores its idf where the whole query equals it.
    """
    parts = []
    for name, weight in text_fields.items():
        own = frames.select("frame_id", F.coalesce(name, F.lit("")).alias("text"))
        parts.append(bm25_scores(own, queries).withColumn("score", F.col("score") * weight))
    for name, weight in (keyword_fields or {}).items():
        own = frames.filter(F.col(name).isNotNull())
        same = own.select("frame_id", F.col(name).alias("query")).join(queries, "query")
        df = own.groupBy(F.col(name).alias("query")).agg(F.count("*").alias("df")).crossJoin(F.broadcast(own.agg(F.count("*").alias("n"))))
        parts.append(same.join(df, "query").select("query_id", "frame_id", (F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * weight).alias("score")))
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "frame_id").agg(F.max("score").alias("score"))


def update_index(index: DataFrame, changes: DataFrame) -> DataFrame:
    """``index(frame_id, text)`` after ``changes(seq, frame_id, text)``, the last of each frame winning; null text removes."""
    last = changes.groupBy("frame_id").agg(F.max_by("text", "seq").alias("text"))
    return index.join(last.select("frame_id"), "frame_id", "left_anti").unionByName(last.filter("text is not null"))
