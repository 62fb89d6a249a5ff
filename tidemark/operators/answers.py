"""Deterministic answers: candidates by pattern from the context's items, the best of the kind that is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators.common import made_once

# The patterns of each kind of answer.
_NAME = r"[A-Z][A-Za-z]*(?:['\-][A-Z][A-Za-z]*)?"
_FULL = rf"{_NAME}(?:\s+{_NAME}){{0,3}}"
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DEPLOYMENT_OWNER = rf"\b({_FULL})\s+owns\s+deployment\s+readiness\b"
OWNER = rf"\b({_FULL})\s+owns\s+([^.,;\n]+?)(?=\s+and\s+{_FULL}\s+owns\b|[.,;\n]|$)"
APPOINTMENT = rf"\b{_MONTH}\s+\d{{1,2}},\s+\d{{4}}\s+at\s+\d{{1,2}}:\d{{2}}\s*(?:AM|PM)\b"
MOVED_CITY = r"\b[Mm]oved\s+to\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"
FLIGHT = r"\b[Ff]light\s+to\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"
ALLERGY = r"\ballergic\s+to\s+([A-Za-z]+(?:\s+[A-Za-z]+)?)\b"
PREFERENCE = r"\bprefers\s+([^\.]+)"
PET = r"\bnamed\s+([A-Z][a-z]+)\b"
ADOPTED = rf"\bin\s+({_MONTH}\s+\d{{4}})\b"
LAUNCH = r"\bpublic\s+launch[^.\n]*"


def _share(hits: Column, of: Column) -> Column:
    return F.size(hits) / F.greatest(F.size(of), F.lit(1))


def analysed(text: Column, prefix: str) -> dict[str, Column]:
    """What relevance compares of a text, to be made once for it."""
    return {f"{prefix}terms": F.array_distinct(t.normalized_terms(text)), f"{prefix}entities": t.entity_terms(text), f"{prefix}years": t.year_terms(text), f"{prefix}dates": t.date_keys(text)}


def relevance(query: Column, text: Column, base: Column) -> Column:
    """The item's score and what it shares with the query: terms, entities, years and dates."""
    return compared([*analysed(query, "").values()], [*analysed(text, "").values()], base)


def compared(asked: list[Column], found: list[Column], base: Column) -> Column:
    """Relevance of analysed texts: terms, entities, years and dates of each."""
    terms, own = asked[0], found[0]
    overlap = F.array_intersect(terms, own)
    score = base + F.when((F.size(terms) > 0) & (F.size(own) > 0), _share(overlap, terms) * 0.70 + _share(overlap, own) * 0.30).otherwise(0.0)
    for wanted, held, gain, loss, only_if_any in zip(asked[1:], found[1:], (0.95, 1.45, 1.25), (0.70, 1.35, 1.10), (False, True, True), strict=True):
        hits = F.array_intersect(wanted, held)
        missed = (F.size(hits) == 0) & ((F.size(held) > 0) if only_if_any else F.lit(True))
        score += F.when(F.size(wanted) > 0, _share(hits, wanted) * gain - F.when(missed, loss).otherwise(0.0)).otherwise(0.0)
    return score


def _one(kind: str, value: Column, score: Column) -> Column:
    return F.when(value != "", F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value"), score.alias("score")))).otherwise(F.array().cast("array<struct<kind:string,value:string,score:double>>"))


def candidates(items: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, ord, kind, value, score)`` of ``items(query_id, position, score, text)``."""
    asked = made_once(queries.select("query_id", "query"), **analysed(F.col("query"), "_q_"))
    cleaned = items.withColumn("text", t.clean_text(F.col("text"))).filter("text <> ''")
    text = F.col("text")
    rows = made_once(cleaned, **analysed(text, "_t_"), _dates=t.date_literals(text)).join(asked, "query_id")
    kinds = ("terms", "entities", "years", "dates")
    rows = made_once(rows, base=compared([F.col(f"_q_{k}") for k in kinds], [F.col(f"_t_{k}") for k in kinds], F.col("score").cast("double")))
    base, terms = F.col("base"), F.col("_q_terms")

    def owned(name: Column, topic: Column) -> Column:
        own = F.array_distinct(t.normalized_terms(topic))
        overlap = F.array_intersect(terms, own)
        score = base + 0.40 + F.when((F.size(terms) > 0) & (F.size(own) > 0), _share(overlap, terms) * 0.80 + _share(overlap, own) * 0.25).otherwise(0.0)
        return F.struct(F.lit("owner").alias("kind"), F.trim(name).alias("value"), (score + F.when(F.contains(t.ascii_lower(topic), F.lit("deployment readiness")), 0.20).otherwise(0.0)).alias("score"))

    first = lambda pattern, group=1: F.trim(F.regexp_extract(text, pattern, group))
    dates = F.coalesce(F.get("_dates", F.lit(0)), F.lit(""))
    launches = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(LAUNCH), F.lit(0)), t.date_literals))
    allergy = first(ALLERGY)
    found = F.concat(
        _one("owner", first(DEPLOYMENT_OWNER), base + 0.60),
        F.zip_with(F.regexp_extract_all(text, F.lit(OWNER), F.lit(1)), F.regexp_extract_all(text, F.lit(OWNER), F.lit(2)), owned),
        _one("launch", F.coalesce(F.get(launches, F.lit(0)), F.lit("")), base + 0.55),
        _one("appointment", first(APPOINTMENT, 0), base + 0.55),
        _one("city", first(MOVED_CITY), base + 0.45),
        _one("flight", first(FLIGHT), base + 0.45),
        _one("allergy", F.when(allergy != "", F.concat(F.lit("allergic to "), allergy)).otherwise(""), base + 0.40),
        _one("preference", first(PREFERENCE), base + 0.35),
        _one("pet", first(PET), base + 0.40),
        _one("adopted", first(ADOPTED), base + 0.40),
        _one("date", dates, base + 0.20),
    )
    return rows.select("query_id", "position", F.posexplode(found).alias("n", "c")).select("query_id", (F.col("position") * 1000 + F.col("n")).alias("ord"), "c.*")


def best_sentences(items: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, sentence)``: the sentence that shares most with the query, digits counting a little; shorter ones win ties."""
    rows = items.join(queries.select("query_id", "query"), "query_id").withColumn("text", t.clean_text(F.col("text"))).filter("text <> ''")
    cut = rows.select("query_id", "query", "position", F.posexplode(t.sentences(F.col("text"))).alias("n", "sentence"))
    terms, own = F.array_distinct(t.normalized_terms(F.col("query"))), t.normalized_terms(F.col("sentence"))
    scored = cut.withColumn("own", own).filter(F.size("own") > 0)
    score = F.size(F.array_intersect(terms, F.array_distinct("own"))) / F.size("own") + F.when(F.col("sentence").rlike("[0-9]"), 0.15).otherwise(0.0)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), F.octet_length("sentence"), "position", "n")
    return scored.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("query_id", "sentence")


def extract_answers(items: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, answer)`` of every query that has items with text."""
    order = Window.partitionBy("query_id", "kind").orderBy(F.desc(F.round("score", 9)), F.octet_length("value"), "ord")
    best = candidates(items, queries).withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    of = best.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "value"))).alias("of"))
    first = items.withColumn("clean", t.clean_text(F.col("text"))).filter("clean <> ''").groupBy("query_id").agg(F.min_by("clean", "position").alias("first"))
    rows = queries.select("query_id", "query").join(first, "query_id").join(of, "query_id", "left").join(best_sentences(items, queries), "query_id", "left")
    low, mask = t.ascii_lower(F.col("query")), t.intent(F.col("query"))
    has = lambda *w: t.contains_any(low, w)
    asks = lambda bit: mask.bitwiseAND(F.lit(bit)) != 0
    got = lambda kind: F.col("of")[kind]
    no_terms = F.size(t.normalized_terms(F.col("query"))) == 0
    answer = F.coalesce(
        F.when(has("dog", "pet", "adopt"), F.concat(got("pet"), F.lit(" in "), got("adopted"))),
        F.when(asks(t.OWNERSHIP) & asks(t.DATE), F.concat(got("owner"), F.lit(" and "), F.coalesce(got("launch"), got("date")))),
        F.when(has("status update", "written"), got("preference")),
        F.when(has("allergy", "allergic"), got("allergy")),
        F.when(has("flying", "flight", "travel"), got("flight")),
        F.when(asks(t.LOCATION), got("city")),
        F.when(asks(t.DATE), F.coalesce(F.when(has("dentist", "appointment"), got("appointment")), got("launch"), got("date"))),
        F.when(asks(t.OWNERSHIP), got("owner")),
        F.when(~no_terms, F.col("sentence")),
        F.col("first"),
    )
    return rows.select("query_id", answer.alias("answer"))
