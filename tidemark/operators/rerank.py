"""Reranking by what a query asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators.answers import analysed
from tidemark.operators.common import made_once


def _n(cond: Column, amount: float | Column) -> Column:
    return F.when(cond, amount).otherwise(0.0)


def _share(hits: Column, of: Column) -> Column:
    return F.size(hits) / F.greatest(F.size(of), F.lit(1))


def _asked(query: Column) -> dict[str, Column]:
    return {"_intent": t.intent(query), **analysed(query, "_q_")}


def _previewed(preview: Column) -> dict[str, Column]:
    return {"_low": t.ascii_lower(preview), **analysed(preview, "_p_")}


def composite(preview: str = "preview", score: str = "score", sources: str = "sources") -> Column:
    """The reranking score of a row that has the columns of ``_asked`` and ``_previewed``; fixed weights stand here together."""
    terms, p_terms, entities, p_entities = (F.col(c) for c in ("_q_terms", "_p_terms", "_q_entities", "_p_entities"))
    letters = lambda a: F.filter(a, lambda w: w.rlike("^[A-Za-z]+$"))
    numeric, alpha, p_alpha = F.filter(entities, lambda w: w.rlike("[0-9]")), letters(entities), letters(p_entities)
    digits = F.filter(terms, lambda w: w.rlike("^[0-9]+$"))
    years, p_years, dates, p_dates = (F.col(c) for c in ("_q_years", "_p_years", "_q_dates", "_p_dates"))
    both, none = F.array_intersect, lambda a, b: F.size(F.array_intersect(a, b)) == 0
    low, has = F.col("_low"), lambda *w: t.contains_any(F.col("_low"), w)
    asks = lambda bit: F.col("_intent").bitwiseAND(F.lit(bit)) != 0
    vector = F.array_contains(F.col(sources), "vector")
    tentative = t.is_tentative(low)
    named, overlap = F.size(entities) > 0, both(terms, p_terms)

    total = F.col(score)
    total += _n((F.size(terms) > 0) & (F.size(p_terms) > 0), _share(overlap, terms) * 0.55 + _share(overlap, p_terms) * 0.25)
    total += _n(F.size(numeric) > 0, _share(both(numeric, p_entities), numeric) * 1.95)
    total += _n(F.size(alpha) > 0, _share(both(alpha, p_alpha), alpha) * 1.25)
    total += _n(named, _share(both(entities, p_entities), entities) * 0.30)
    missed = named & none(entities, p_entities)
    total -= _n(missed, F.when(F.size(numeric) > 0, 0.85).otherwise(0.45))
    total -= _n(missed & ~none(digits, p_terms), 0.75)
    total -= _n((F.size(alpha) > 0) & none(alpha, p_alpha) & (F.size(p_alpha) > 0), 0.40)
    total += _n(F.size(years) > 0, _share(both(years, p_years), years) * 1.25)
    total -= _n((F.size(years) > 0) & none(years, p_years) & (F.size(p_years) > 0), 1.10)
    total += _n(F.size(dates) > 0, _share(both(dates, p_dates), dates) * 1.15)
    total -= _n((F.size(dates) > 0) & none(dates, p_dates) & (F.size(p_dates) > 0), 0.95)

    place = F.when(t.moved_to_place(F.col(preview)), 1.60).when(has("moved to", "move to"), 0.45).when(has("city"), 0.10).otherwise(0.0)
    place -= _n(has("without a destination", "city move", "retrospective"), 0.75) + _n(has("allergic", "health", "peanut"), 1.10) + _n(has("prefer"), 0.55)
    total += _n(asks(t.LOCATION), place)
    launch = F.when(has("public launch is") & ~tentative, 1.70).when(has("public launch") | t.has_date_literal(F.col(preview)), 1.20).otherwise(0.0)
    launch -= _n(tentative, F.greatest(F.when(vector, 2.90).otherwise(2.45), F.col(score) * F.when(vector, 1.60).otherwise(1.40)))
    launch -= _n(has("draft memo"), F.when(vector, 1.45).otherwise(1.20)) + _n(has(" owns ", "owner", "deployment readiness"), 0.40)
    total += _n(asks(t.DATE), launch)
    total += _n(asks(t.OWNERSHIP), _n(has(" owns ", "owner", "owns deployment readiness"), 1.10) - _n(has("public launch") & ~has(" owns "), 0.35))
    total -= _n(t.is_distractor(low), 0.40)
    return F.when(F.coalesce(F.col(preview), F.lit("")) == "", F.col(score)).otherwise(total)


def is_reranked(query: Column) -> Column:
    """Only queries that ask for a place, a date or an owner, and name an entity, a year or a date."""
    asked = t.intent(query).bitwiseAND(F.lit(t.LOCATION | t.DATE | t.OWNERSHIP)) != 0
    return asked & ((F.size(t.entity_terms(query)) > 0) | (F.size(t.year_terms(query)) > 0) | (F.size(t.date_keys(query)) > 0))


def intent_rerank(rows: DataFrame, queries: DataFrame, window: int = 12, digits: int = 6) -> DataFrame:
    """``rows(query_id, rank, frame_id, score, preview, sources)`` with ``rank`` as reranked and ``composite`` beside it.

    The first ``window`` rows of a query change places among themselves, the others keep theirs; scores stay.
    """
    asked = made_once(queries.select("query_id", "query"), **_asked(F.col("query"))).withColumn("_reranked", is_reranked(F.col("query"))).drop("query")
    joined = rows.join(asked, "query_id")
    size = F.least(F.lit(max(0, window)), F.count("*").over(Window.partitionBy("query_id")))
    placed = joined.withColumn("head", (F.col("rank") <= size) & (size > 1) & F.col("_reranked"))
    # texts of rows that keep their place are not looked at
    seen = made_once(placed.withColumn("_text", F.when(F.col("head"), F.coalesce("preview", F.lit(""))).otherwise("")), **_previewed(F.col("_text")))
    scored = seen.withColumn("composite", F.when(F.col("head"), F.round(composite(), digits)))
    order = Window.partitionBy("query_id", "head").orderBy(F.desc("composite"), F.desc("score"), F.asc("frame_id"))
    return scored.withColumn("rank", F.when(F.col("head"), F.row_number().over(order)).otherwise(F.col("rank"))).select("query_id", "rank", "frame_id", "score", "preview", "sources", "composite")
