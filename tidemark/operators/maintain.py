"""Summaries, importance, tiers and access statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import WHITE, flag, specificity
from tidemark.operators.common import made_once

TIER_TOKENS = {"full": 100, "gist": 25, "micro": 8}
TIER_ITEMS = {"full": (8, "\n"), "gist": (3, " "), "micro": (1, " ")}


def segments(text: Column) -> Column:
    """Pieces that end with one of ``. ! ? ;`` or the end of line, trimmed."""
    cut = F.regexp_extract_all(text, F.lit(r"[^.!?;\n]*[.!?;\n]|[^.!?;\n]+$"), F.lit(0))
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")), lambda s: s != "")


def scoring_tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z]+"), F.lit(0)), lambda t: F.length(t) > 2)


def segment_score(segment: Column) -> Column:
    """Length with bounds, and what speaks for content: digits, colons, code, bullets, variety."""
    tokens = scoring_tokens(segment)
    n = F.size(tokens)
    length = F.least(n, F.lit(40)) * F.when(n < 4, 0.25).otherwise(1.0) * F.when(n > 80, 0.7).otherwise(1.0)
    signs = F.when(segment.rlike("[0-9]"), 6.0).otherwise(0.0) + F.when(F.contains(segment, F.lit(":")), 4.0).otherwise(0.0) + F.when(F.contains(segment, F.lit("`")), 2.0).otherwise(0.0)
    return length + signs + F.when(segment.rlike("^[-*]"), 2.0).otherwise(0.0) + F.when(n > 0, F.size(F.array_distinct(tokens)) / n * 3.0).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def _pick(scores: list[float], bags: list[set[str]], most: int) -> list[int]:
    """Positions in the order of a maximal-marginal-relevance choice; ties go to the better score, then the earlier one.

    What a segment is worth never exceeds its score, so a step ends at the first score that is no better than the best
    found, and a segment is compared only with those chosen since it was last looked at.
    """
    left = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    near, seen, chosen = [0.0] * len(scores), [0] * len(scores), []
    while left and len(chosen) < most:
        best, worth = left[0], -1.0
        for i in left:
            if scores[i] <= worth:
                break
            for j in chosen[seen[i] :]:
                both = len(bags[i] & bags[j])
                near[i] = max(near[i], both / (len(bags[i]) + len(bags[j]) - both) if both else 0.0)
            seen[i] = len(chosen)
            if (own := scores[i] * (1 - near[i])) > worth:
                best, worth = i, own
        left.remove(best)
        chosen.append(best)
    return chosen


def summarize(frames: DataFrame, budgets: dict[str, int] | None = None) -> DataFrame:
    """``(frame_id, full, gist, micro)``: extractive summaries of three sizes, none for texts without words."""
    budgets = budgets or TIER_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {tier: [] for tier in TIER_ITEMS}
            for parts, scores, tokens in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                order = _pick(scores, [set(x) for x in tokens], max(most for most, _ in TIER_ITEMS.values()))
                for tier, (most, glue) in TIER_ITEMS.items():  # a smaller choice is the beginning of a larger one
                    words = re.findall(r"\S+\s*", glue.join(parts[i] for i in sorted(order[:most])))
                    made[tier].append("".join(words[: budgets[tier]]).rstrip())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.string()) for x in made.values()]], names=["frame_id", *made])

    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), WHITE, " "))
    rows = made_once(frames.select("frame_id", flat.alias("flat")), parts=segments(F.col("flat"))).filter(F.size("parts") > 0)
    rows = rows.select("frame_id", "parts", F.transform("parts", segment_score).alias("scores"), F.transform("parts", lambda s: F.array_distinct(scoring_tokens(s))).alias("tokens"))
    return rows.mapInArrow(run, "frame_id long, full string, gist string, micro string")


def summary_candidates(frames: DataFrame, existing: DataFrame | None = None, overwrite: bool = False, limit: int | None = None) -> DataFrame:
    """Frames to summarize: active, current (unless overwriting), with text, no summaries themselves, none made yet."""
    rows = frames.filter("status = 0 and trim(coalesce(text, '')) <> ''").filter(~F.coalesce(flag(F.col("metadata")["surrogate"]), F.lit(False)))
    if not overwrite:
        rows = rows.filter("superseded_by is null")
        if existing is not None:
            rows = rows.join(existing.select("frame_id").distinct(), "frame_id", "left_anti")
    return rows.orderBy("frame_id").limit(limit) if limit else rows


def access_stats(log: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """``(frame_id, accesses, first_ms, last_ms)`` of ``log(frame_id, ts_ms)``, the count ending at 2^32 - 1."""
    rows = log.join(active.select("frame_id").distinct(), "frame_id", "left_semi") if active is not None else log
    return rows.groupBy("frame_id").agg(F.least(F.count("*"), F.lit((1 << 32) - 1)).alias("accesses"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def merge_access(*stats: DataFrame) -> DataFrame:
    """Access statistics of several sources (exports, another log) as one."""
    rows = reduce(DataFrame.unionByName, stats)
    return rows.groupBy("frame_id").agg(F.least(F.sum("accesses"), F.lit((1 << 32) - 1)).alias("accesses"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


def prune_access(stats: DataFrame, active: DataFrame) -> DataFrame:
    """The statistics of frames that are still there."""
    return stats.join(active.select("frame_id").distinct(), "frame_id", "left_semi")


def importance(age_ms: Column, accesses: Column, since_ms: Column, weights: tuple[float, float, float] = (0.3, 0.4, 0.3), hours: tuple[float, float] = (168.0, 24.0)) -> Column:
    """Age, use and time since the last use, weighed; frames that were never used have only their age."""
    hour = 3_600_000.0
    age = F.exp(-F.greatest(age_ms, F.lit(0)) / hour / hours[0])
    use = F.coalesce(F.least(F.lit(1.0), F.log1p(accesses) / 5.0), F.lit(0.0))
    since = F.coalesce(F.exp(-F.greatest(since_ms, F.lit(0)) / hour / hours[1]), F.lit(0.0))
    return (weights[0] * age + weights[1] * use + weights[2] * since) / sum(weights)


def tier(policy: str, age_ms: Column, score: Column | None = None, query: Column | None = None, boost: float = 0.15) -> Column:
    """``full``, ``gist`` or ``micro`` by policy: ``disabled``, ``age`` (7 and 30 days) or ``importance`` (0.6 and 0.3)."""
    day = 86_400_000
    if policy == "disabled":
        return F.lit("full")
    if policy == "age":
        return F.when(age_ms < 7 * day, "full").when(age_ms < 30 * day, "gist").otherwise("micro")
    if policy != "importance" or score is None:
        raise ValueError("policy is disabled, age or importance (with a score)")
    held = score if query is None else F.least(F.lit(1.0), score + specificity(query) * boost)
    return F.when(held >= 0.6, "full").when(held >= 0.3, "gist").otherwise("micro")


def tiered_text(tiers: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(frame_id, text)`` of ``chosen(frame_id, tier)``."""
    return chosen.join(tiers, "frame_id").select("frame_id", F.when(F.col("tier") == "full", F.col("full")).when(F.col("tier") == "gist", F.col("gist")).otherwise(F.col("micro")).alias("text"))


def importance_rollup(scored: DataFrame, by: list[str]) -> DataFrame:
    """Counts and mean score by each prefix of the grouping columns."""
    return scored.rollup(*by).agg(F.count("*").alias("frames"), F.round(F.avg("score"), 6).alias("mean_score"))


def sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """``(user_id, session, first_ts, last_ts, events)`` of ``events(user_id, ts)``: a new session after each gap."""
    windowed = events.groupBy("user_id", F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))
    return windowed.select("user_id", "first_ts", "last_ts", "events")

