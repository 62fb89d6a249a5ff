"""The queries of the engine's own operators, each over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import hashing, vectors
from tidemark.functions import text as t
from tidemark.operators import answers, chunks, context, enrich, facts, fulltext, fusion, graph, maintain, rerank, store, vector_search
from tidemark.plans import tables as T
from tidemark.sources.files import filter_entries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def quoted(words: list[str] | tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_LOWER = f"translate({{0}}, '{t.UPPER}', '{t.LOWER}')"
_SPACE = r"[ \t\n\r\f\x0B]+"


def lower(c: str) -> str:
    return _LOWER.format(c)


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{_SPACE}'), lambda w: w <> '')"


def sql_any(c: str, needles: tuple[str, ...] | list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{n}')" for n in needles) + ")"


def sql_stem(w: str) -> str:
    n = f"length({w})"
    return f"CASE WHEN {n} > 3 AND suffix({w}, 'ies') THEN left({w}, {n} - 3) || 'y' WHEN {n} > 3 AND suffix({w}, 'ing') THEN left({w}, {n} - 3) WHEN {n} > 2 AND suffix({w}, 'ed') THEN left({w}, {n} - 2) WHEN {n} > 2 AND suffix({w}, 's') THEN left({w}, {n} - 1) ELSE {w} END"


FRAMES = """frames AS (SELECT doc_id AS frame_id, doc_id * 60000 AS ts_ms, text, CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS status, lang, source,
  CASE WHEN doc_id % 17 = 0 THEN doc_id + 1 END AS superseded_by, CASE WHEN doc_id % 17 = 1 THEN doc_id - 1 END AS supersedes FROM documents)"""
ASKED = f"""asked AS (SELECT query_id, unnest(CASE WHEN len(kept) = 0 THEN tokens ELSE kept END) AS token FROM (
  SELECT query_id, tokens, list_filter(tokens, lambda w: w NOT IN ({quoted(t.SEARCH_STOP_WORDS)})) AS kept FROM (
    SELECT item_id AS query_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w)) AS tokens FROM benchmark)))"""


# ---- filters and predicates


@query("SELECT doc_id AS frame_id FROM documents WHERE doc_id % 13 <> 0")
def scan_filter_status(spark, d):
    return store.active(T.frames(spark, d)).select("frame_id")


@query(f"WITH {FRAMES} SELECT frame_id FROM frames WHERE status = 0 AND superseded_by IS NULL AND ts_ms >= 600000 AND ts_ms < 30000000 AND lang = 'en' AND source IN ('src1') AND frame_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def frame_filter_labels(spark, d):
    frames = T.frames(spark, d)
    good = T.read(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("frame_id"))
    return fusion.filter_frames(frames.select("frame_id"), frames, ids=good, after_ms=600_000, before_ms=30_000_000, metadata={"lang": "en"}, labels=["src1"])


@query(f"WITH {FRAMES} SELECT frame_id, ts_ms FROM frames WHERE ts_ms >= 1200000 AND ts_ms < 6000000")
def time_range(spark, d):
    frames = T.frames(spark, d)
    return fusion.filter_frames(frames.select("frame_id", "ts_ms"), frames, after_ms=1_200_000, before_ms=6_000_000, deleted=True, superseded=True)


EAV = """eav AS (
  SELECT 'nation:' || n_nationkey AS entity, n_nationkey::BIGINT AS id, unnest(['n_name', 'n_regionkey']) AS attribute, unnest([n_name, n_regionkey::VARCHAR]) AS value FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, s_suppkey, unnest(['s_name', 's_nationkey']), unnest([s_name, s_nationkey::VARCHAR]) FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, c_custkey, unnest(['c_name', 'c_mktsegment', 'c_nationkey']), unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) FROM customer)"""


@query(f"WITH {EAV} SELECT entity, attribute, id, value FROM eav WHERE starts_with(entity, 'customer:1')")
def entity_prefix(spark, d):
    return facts.by_prefix(T.eav(spark, d), "customer:1", -1).select("entity", "attribute", "id", "value")


@query(f"WITH {EAV} SELECT lower(trim(regexp_replace(entity || '|' || attribute || '|' || value, '\\s+', ' ', 'g'))) AS line, min(id) AS id FROM eav GROUP BY 1")
def facts_dedup(spark, d):
    return facts.unique_lines(T.eav(spark, d)).select("line", "id")


@query(f"WITH {EAV} SELECT entity, attribute, value FROM eav WHERE regexp_matches(lower(entity || ' ' || attribute || ' ' || value), 'automobile|machinery|nation')")
def keyword_facts(spark, d):
    return enrich.keyword_facts(T.eav(spark, d), ["automobile", "machinery", "nation"]).select("entity", "attribute", "value")


# ---- full text


@query(f"WITH {ASKED} SELECT query_id, token, count(*) AS times FROM asked GROUP BY ALL")
def tokenize_stop(spark, d):
    return fulltext.query_tokens(T.queries(spark, d))


@query("SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS token FROM documents) GROUP BY token")
def doc_freq(spark, d):
    return fulltext.document_frequency(T.frames(spark, d))


TFIDF = f"""{ASKED}, weights AS (SELECT query_id, token, count(*) AS times FROM asked GROUP BY ALL),
post AS (SELECT frame_id, token, count(*) AS tf FROM (SELECT doc_id AS frame_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS token FROM documents) WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token), n AS (SELECT count(*) AS n FROM documents),
scores AS (SELECT query_id, frame_id, round(sum(times * tf * (ln((n + 1) / (df + 1)) + 1)), 6) AS score FROM post JOIN df USING (token) JOIN weights USING (token), n GROUP BY ALL)"""
BEST = "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS rank, frame_id, score FROM {0} QUALIFY rank <= 10"


@query(f"WITH {TFIDF} {BEST.format('scores')}")
def tfidf_topk(spark, d):
    return fulltext.tfidf_search(T.frames(spark, d), T.queries(spark, d))


def sql_bm25(name: str, text: str = "text") -> str:
    return f"""{name}_tokens AS (SELECT doc_id AS frame_id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS tokens FROM documents),
{name}_stats AS (SELECT count(*) AS n, avg(len(tokens)) AS mean_length FROM {name}_tokens),
{name}_post AS (SELECT frame_id, length, token, count(*) AS tf FROM (SELECT frame_id, len(tokens) AS length, unnest(tokens) AS token FROM {name}_tokens) WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
{name}_df AS (SELECT token, count(*) AS df FROM {name}_post GROUP BY token),
{name} AS (SELECT query_id, frame_id, sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score
  FROM {name}_post JOIN {name}_df USING (token) JOIN (SELECT DISTINCT query_id, token FROM asked) USING (token), {name}_stats GROUP BY ALL)"""


ROUNDED = "{0}_r AS (SELECT query_id, frame_id, round(score, 6) AS score FROM {0} WHERE round(score, 6) > 0)"


@query(f"WITH {ASKED}, {sql_bm25('bm')}, {ROUNDED.format('bm')} {BEST.format('bm_r')}")
def bm25_topk(spark, d):
    return fulltext.bm25_search(T.frames(spark, d), T.queries(spark, d))


@query(f"""WITH {ASKED}, {sql_bm25('bm')}, {ROUNDED.format('bm')}, head AS (SELECT query_id, frame_id FROM bm_r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) <= 100),
weights AS (SELECT query_id, token, count(*) AS times FROM asked GROUP BY ALL),
post AS (SELECT frame_id, token, count(*) AS tf FROM (SELECT doc_id AS frame_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS token FROM documents) WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token), n AS (SELECT count(*) AS n FROM documents),
scores AS (SELECT query_id, frame_id, round(sum(times * tf * (ln((n + 1) / (df + 1)) + 1)), 6) AS score FROM post JOIN df USING (token) JOIN weights USING (token) JOIN head USING (query_id, frame_id), n GROUP BY ALL) {BEST.format('scores')}""")
def rescored_topk(spark, d):
    return fulltext.rescored_search(T.frames(spark, d), T.queries(spark, d))


_LEAD = f"array_to_string(list_slice({sql_words('text')}, 1, 20), ' ')"


@query(f"""WITH {ASKED}, {sql_bm25('body')}, {sql_bm25('lead', _LEAD)}, best AS (SELECT query_id, frame_id, round(max(score), 6) AS score FROM (
  SELECT query_id, frame_id, score FROM body UNION ALL SELECT query_id, frame_id, 2 * score FROM lead) GROUP BY ALL HAVING round(max(score), 6) > 0) {BEST.format('best')}""")
def multi_field_bm25(spark, d):
    frames = T.frames(spark, d).select("frame_id", "text", t.first_words(F.col("text"), 20).alias("lead"))
    return fulltext.best(fulltext.best_field_scores(frames, T.queries(spark, d), {"text": 1.0, "lead": 2.0}))


@query("""WITH asked AS (SELECT DISTINCT 's:' || source AS query_id, source FROM documents), df AS (SELECT source, count(*) AS df FROM documents GROUP BY source), n AS (SELECT count(*) AS n FROM documents)
SELECT query_id, doc_id AS frame_id, round(2 * ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS score FROM documents JOIN asked USING (source) JOIN df USING (source), n""")
def keyword_field(spark, d):
    frames = T.frames(spark, d).select("frame_id", F.col("metadata")["source"].alias("source"))
    asked = frames.select("source").distinct().select(F.concat(F.lit("s:"), "source").alias("query_id"), F.col("source").alias("query"))
    return fulltext.best_field_scores(frames, asked, {}, {"source": 2.0}).select("query_id", "frame_id", F.round("score", 6).alias("score"))


@query("""WITH changes AS (SELECT doc_id AS seq, doc_id % 50 AS frame_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS text FROM documents), last AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY seq DESC) = 1)
SELECT doc_id AS frame_id, sha256(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT frame_id FROM last) UNION ALL SELECT frame_id, sha256(text) FROM last WHERE text IS NOT NULL""")
def index_update(spark, d):
    index = T.frames(spark, d).select("frame_id", "text")
    changes = index.select(F.col("frame_id").alias("seq"), (F.col("frame_id") % 50).alias("frame_id"), F.when(F.col("frame_id") % 3 != 0, F.col("text")).alias("text"))
    return fulltext.update_index(index, changes).select("frame_id", F.sha2("text", 256).alias("digest"))


# ---- vectors

_VEC = "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"
_DOT = "list_sum(list_transform(generate_series(1, len({0})), lambda i: {0}[i] * {1}[i]))"
_KNN = "WITH e AS (" + _VEC + "), s AS (SELECT q.vec_id AS query_id, e.vec_id AS frame_id, round({0}, 6) AS score FROM e, (SELECT * FROM e WHERE vec_id % 50 = 0) q {1}) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS rank, frame_id, score FROM s QUALIFY rank <= 10"


@query(_KNN.format("list_cosine_similarity(e.v, q.v)", ""))
def knn_cosine(spark, d):
    return vector_search.knn_exact(T.vectors(spark, d), T.vector_queries(spark, d), "cosine")


@query(_KNN.format("list_inner_product(e.v, q.v)", ""))
def knn_dot(spark, d):
    return vector_search.knn_exact(T.vectors(spark, d), T.vector_queries(spark, d), "dot")


@query(_KNN.format("-list_distance(e.v, q.v) * list_distance(e.v, q.v)", ""))
def knn_l2(spark, d):
    return vector_search.knn_exact(T.vectors(spark, d), T.vector_queries(spark, d), "l2")


@query(_KNN.format("list_cosine_similarity(e.v, q.v)", "WHERE e.label = 3"))
def knn_filtered(spark, d):
    return vector_search.knn_exact(T.vectors(spark, d).filter("label = 3"), T.vector_queries(spark, d), "cosine")


@query("WITH e AS (" + _VEC + "), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS m FROM e) SELECT vec_id, round(m, 6) AS magnitude, abs(m - 1) <= 1e-3 AS is_normalized, round(v[1] / m, 6) AS first, round(list_sum(v) / m, 6) AS total FROM n")
def normalize_l2(spark, d):
    v = T.vectors(spark, d)
    n = vectors.normalize(F.col("embedding"))
    return v.select(F.col("frame_id").alias("vec_id"), F.round(vectors.magnitude(F.col("embedding")), 6).alias("magnitude"), vectors.is_normalized(F.col("embedding")).alias("is_normalized"), F.round(F.get(n, F.lit(0)), 6).alias("first"), F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("WITH e AS (" + _VEC + """), p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum(a) + list_sum(b), 6) AS added, round(list_sum(a) - list_sum(b), 6) AS subtracted, round(list_sum(a) * 2.5, 6) AS scaled, round(list_inner_product(a, b), 6) AS dot, round(list_distance(a, b), 6) AS distance, round(list_cosine_similarity(a, b), 6) AS cosine FROM p""")
def vec_add_sub_scale(spark, d):
    v = T.vectors(spark, d).select("frame_id", "embedding")
    p = v.join(v.select((F.col("frame_id") - 1).alias("frame_id"), F.col("embedding").alias("b")), "frame_id")
    a, b, total = F.col("embedding"), F.col("b"), lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda s, y: s + y), 6)
    return p.select(F.col("frame_id").alias("vec_id"), total(vectors.add(a, b)).alias("added"), total(vectors.subtract(a, b)).alias("subtracted"), total(vectors.scale(a, 2.5)).alias("scaled"), F.round(vectors.dot(a, b), 6).alias("dot"), F.round(vectors.distance(a, b), 6).alias("distance"), F.round(vectors.cosine(a, b), 6).alias("cosine"))


@query("""WITH j AS (SELECT event_id AS seq, user_id AS frame_id, CASE WHEN event_type = 'error' THEN [1.0] WHEN event_type = 'view' THEN [] ELSE [value, value + 1] END AS v FROM events),
good AS (SELECT * FROM j WHERE len(v) > 0), dim AS (SELECT len(arg_min(v, seq)) AS n FROM good), fit AS (SELECT good.* FROM good, dim WHERE len(v) = n)
SELECT frame_id, round(v[1], 6) AS first, len(v) AS dim FROM fit QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY seq DESC) = 1""")
def embedding_journal(spark, d):
    e = T.read(spark, d, "events")
    v = F.when(F.col("event_type") == "error", F.array(F.lit(1.0))).when(F.col("event_type") == "view", F.array().cast("array<double>")).otherwise(F.array("value", F.col("value") + 1))
    latest = vector_search.latest_valid(e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("frame_id"), v.alias("embedding")))
    return latest.select("frame_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.size("embedding").cast("bigint").alias("dim"))


# ---- fusion

LANES = f"""{ASKED}, {sql_bm25('bm')}, {ROUNDED.format('bm')}, text_lane AS ({BEST.format('bm_r')}),
e AS ({_VEC}), vec AS (SELECT q.vec_id AS query_id, e.vec_id AS frame_id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e, (SELECT * FROM e WHERE vec_id IN (SELECT item_id FROM benchmark)) q),
vector_lane AS ({BEST.format('vec')})"""


def _lanes(spark, d) -> DataFrame:
    text = fulltext.bm25_search(T.frames(spark, d), T.queries(spark, d))
    asked = T.vectors(spark, d).join(T.queries(spark, d).select(F.col("query_id").alias("frame_id")), "frame_id", "left_semi").select(F.col("frame_id").alias("query_id"), "embedding")
    vector = vector_search.knn_exact(T.vectors(spark, d), asked)
    lane = lambda rows, name: rows.select("query_id", F.lit(name).alias("lane"), "frame_id", "score", F.lit(None).cast("string").alias("preview"))
    return lane(text, "text").unionByName(lane(vector, "vector"))


@query(f"WITH {LANES} SELECT query_id, 'text' AS lane, frame_id, score FROM text_lane UNION ALL SELECT query_id, 'vector', frame_id, score FROM vector_lane")
def union_lanes(spark, d):
    return _lanes(spark, d).drop("preview")


def sql_rrf(alpha: str, source: str = "") -> str:
    return f"""fused AS (SELECT query_id, frame_id, round(sum(w / (60 + rank)), 9) AS score, array_to_string(list_sort(list(DISTINCT lane)), ',') AS sources FROM (
  SELECT query_id, frame_id, rank, 'text' AS lane, {alpha} AS w FROM text_lane {source} UNION ALL SELECT query_id, frame_id, rank, 'vector', 1 - {alpha} FROM vector_lane {source}) WHERE w > 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS rank, frame_id, score, sources FROM fused QUALIFY rank <= 10"""


@query(f"WITH {LANES}, {sql_rrf('0.5')}")
def rrf_hybrid(spark, d):
    return fusion.weighted_rrf(_lanes(spark, d)).select("query_id", "rank", "frame_id", "score", F.array_join("sources", ",").alias("sources"))


def sql_class(q: str) -> str:
    low = lower(q)
    starts = " OR ".join(f"starts_with({low}, '{s}')" for s in t.FACTUAL_STARTS)
    return f"CASE WHEN {sql_any(low, t.TEMPORAL_WORDS)} THEN 'temporal' WHEN {starts} OR {sql_any(low, t.FACTUAL_WORDS)} THEN 'factual' WHEN {sql_any(low, t.SEMANTIC_WORDS)} THEN 'semantic' ELSE 'exploratory' END"


ALPHA = "alphas AS (SELECT query_id, class, CASE class WHEN 'factual' THEN 0.7 WHEN 'semantic' THEN 0.3 WHEN 'temporal' THEN 0.25 WHEN 'exploratory' THEN 0.4 ELSE 0.5 END AS alpha FROM (SELECT item_id AS query_id, " + sql_class("text") + " AS class FROM benchmark))"


@query(f"WITH {LANES}, {ALPHA}, {sql_rrf('alpha', 'JOIN alphas USING (query_id)')}")
def adaptive_fusion(spark, d):
    weights = fusion.adaptive_weights(T.queries(spark, d)).drop("class")
    return fusion.weighted_rrf(_lanes(spark, d), weights).select("query_id", "rank", "frame_id", "score", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {LANES}, s AS (SELECT query_id, frame_id, round(sum(x), 8) AS score FROM (SELECT query_id, frame_id, score * 0.3 AS x FROM text_lane UNION ALL SELECT query_id, frame_id, (1 + score) / 2 * 0.7 FROM vector_lane) GROUP BY ALL) {BEST.format('s')}")
def weighted_hybrid(spark, d):
    lanes = _lanes(spark, d)
    return fusion.blend_scores(lanes.filter("lane = 'text'"), lanes.filter("lane = 'vector'"))


@query("""WITH r AS (SELECT user_id AS query_id, event_id % 20 AS frame_id, event_type AS lane, value AS score, props AS preview, max(value) OVER (PARTITION BY user_id, event_id % 20) AS top FROM events)
SELECT query_id, frame_id, round(max(score), 6) AS score, coalesce(min(CASE WHEN score = top THEN preview END), min(preview)) AS preview, array_to_string(list_sort(list(DISTINCT lane)), ',') AS sources FROM r GROUP BY ALL""")
def merge_duplicates(spark, d):
    e = T.read(spark, d, "events").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 20).alias("frame_id"), F.col("event_type").alias("lane"), F.col("value").alias("score"), F.col("props").alias("preview"))
    return fusion.merge_duplicates(e).select("query_id", "frame_id", F.round("score", 6).alias("score"), "preview", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {LANES} SELECT query_id, frame_id, string_agg(lane || ':' || rank, ',' ORDER BY lane) AS lanes FROM (SELECT query_id, frame_id, rank, 'text' AS lane FROM text_lane UNION ALL SELECT query_id, frame_id, rank, 'vector' FROM vector_lane) GROUP BY ALL")
def lane_diagnostics(spark, d):
    lanes = fusion.rank_diagnostics(_lanes(spark, d))
    return lanes.select("query_id", "frame_id", F.array_join(F.transform("lanes", lambda x: F.concat(x["lane"], F.lit(":"), x["rank"].cast("string"))), ",").alias("lanes"))


@query("SELECT item_id AS query_id, doc_id AS frame_id, (doc_id * 60000)::DOUBLE AS score FROM benchmark, (SELECT doc_id FROM documents WHERE doc_id % 13 <> 0 ORDER BY doc_id DESC LIMIT 10)")
def timeline_lane(spark, d):
    return fusion.timeline_lane(T.frames(spark, d), T.queries(spark, d)).select("query_id", "frame_id", "score")


@query("SELECT source AS query_id, doc_id AS frame_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1")
def content_dedup(spark, d):
    rows = T.frames(spark, d).select(F.col("metadata")["source"].alias("query_id"), "frame_id", F.col("text").alias("preview"))
    return fusion.drop_repeated_text(rows, order="frame_id").select("query_id", "frame_id")


# ---- query analysis


@query(f"SELECT item_id AS query_id, {sql_class('text')} AS class FROM benchmark")
def classify(spark, d):
    return T.queries(spark, d).select("query_id", t.query_class(F.col("query")).alias("class"))


def sql_intent(q: str) -> str:
    low = lower(q)
    bits = {b: sql_any(low, w) for b, w in t.INTENT_WORDS.items()}
    total = " + ".join(f"(CASE WHEN {c} THEN {b} ELSE 0 END)" for b, c in bits.items())
    n = " + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for c in bits.values())
    return f"{total} + (CASE WHEN contains({low}, ' and ') AND {n} >= 2 THEN {t.MULTI_HOP} ELSE 0 END)"


@query(f"SELECT conv_id, turn, ({sql_intent('text')})::BIGINT AS intent FROM conversations")
def detect_intent(spark, d):
    return T.read(spark, d, "conversations").select("conv_id", "turn", t.intent(F.col("text")).cast("bigint").alias("intent"))


def sql_entities(source: str, key: str) -> str:
    return f"""terms AS (SELECT {key}, w, regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]') AS mixed, lag(w) OVER (PARTITION BY {key} ORDER BY i) AS before FROM (
  SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT {key}, {sql_words(lower('text'))} AS ws FROM {source}))),
entities AS (SELECT DISTINCT {key}, w FROM terms WHERE mixed OR (w NOT IN ({quoted(t.ENTITY_CUES)}) AND w NOT IN ({quoted(t.TERM_STOP_WORDS)}) AND w NOT IN ({quoted(t.ENTITY_NOISE)}) AND coalesce(before, '') IN ({quoted(t.NAME_FOLLOWERS + t.ENTITY_CUES)})))"""


@query(f"WITH {sql_entities('benchmark', 'item_id')} SELECT item_id AS query_id, w AS entity FROM entities")
def entity_terms(spark, d):
    return T.queries(spark, d).select("query_id", F.explode(t.entity_terms(F.col("query"))).alias("entity"))


@query(f"""WITH {sql_entities('benchmark', 'item_id')} SELECT item_id AS query_id, len({sql_words('text')})::BIGINT AS words, regexp_matches(text, '"[^"]+"') AS quoted,
  round(least(1.0, least(len({sql_words('text')}) / 8.0, 0.4) + (CASE WHEN item_id IN (SELECT item_id FROM entities) THEN 0.35 ELSE 0 END) + (CASE WHEN regexp_matches(text, '"[^"]+"') THEN 0.25 ELSE 0 END)), 6)::DOUBLE AS specificity FROM benchmark""")
def query_signals(spark, d):
    q = F.col("query")
    return T.queries(spark, d).select("query_id", F.size(t.words(q)).cast("bigint").alias("words"), t.has_quoted_phrase(q).alias("quoted"), F.round(t.specificity(q), 6).cast("double").alias("specificity"))


@query(f"SELECT item_id AS query_id, array_to_string(list_transform(list_filter({sql_words(lower('text'))}, lambda w: w NOT IN ({quoted(t.TERM_STOP_WORDS)})), lambda w: {sql_stem('w')}), ' ') AS terms FROM benchmark")
def normalized_terms(spark, d):
    return T.queries(spark, d).select("query_id", F.array_join(t.normalized_terms(F.col("query")), " ").alias("terms"))


_DATED = "SELECT o_orderkey, 'Order ' || o_orderkey || ' was due on ' || strftime(o_orderdate, '%Y-%m-%d') || ' or ' || strftime(o_orderdate, '%Y/%-m/%-d') || ', in ' || year(o_orderdate) || '.' AS text FROM orders"


def _dated(spark, d) -> DataFrame:
    day = F.col("o_orderdate")
    return T.read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" was due on "), F.date_format(day, "yyyy-MM-dd"), F.lit(" or "), F.date_format(day, "yyyy/M/d"), F.lit(", in "), F.year(day).cast("string"), F.lit(".")).alias("text"))


@query(f"WITH o AS ({_DATED}) SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[0-9A-Za-z]+'), lambda r: regexp_matches(r, '^(19|20)[0-9]{{2}}$')))), ',') AS years FROM o")
def year_terms(spark, d):
    return _dated(spark, d).select("o_orderkey", F.array_join(t.year_terms(F.col("text")), ",").alias("years"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dates FROM orders")
def date_keys(spark, d):
    return _dated(spark, d).select("o_orderkey", F.array_join(t.date_keys(F.col("text")), ",").alias("dates"))


@query(r"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]'), lambda s: trim(s, E' \t\r\f\x0B')), lambda s: s <> '') AS s FROM documents) SELECT doc_id AS frame_id, len(s)::BIGINT AS sentences, sha256(array_to_string(s, '|')) AS digest FROM s")
def split_sentences(spark, d):
    s = t.sentences(F.col("text"))
    return T.frames(spark, d).select("frame_id", F.size(s).cast("bigint").alias("sentences"), F.sha2(F.array_join(s, "|"), 256).alias("digest"))


@query(f"SELECT doc_id AS frame_id, sha256(trim(regexp_replace(translate(text, '[]', ''), '{_SPACE}', ' ', 'g'))) AS digest FROM documents")
def clean_text(spark, d):
    return T.frames(spark, d).select("frame_id", F.sha2(t.clean_text(F.col("text")), 256).alias("digest"))


@query("SELECT doc_id AS frame_id, ceil(octet_length(encode(text)) / 4)::BIGINT AS tokens, len(regexp_extract_all(text, '[!-/:-@\\[-`{-~]|[^\\s!-/:-@\\[-`{-~]+'))::BIGINT AS prompt_tokens FROM documents")
def token_count(spark, d):
    return T.frames(spark, d).select("frame_id", t.token_estimate(F.col("text")).alias("tokens"), t.prompt_tokens(F.col("text")).cast("bigint").alias("prompt_tokens"))


# ---- contexts, reranking, answers


@query(f"""WITH o AS (SELECT source AS query_id, doc_id AS frame_id, n_chars::DOUBLE AS score, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pos FROM documents),
f AS (SELECT * FROM o WHERE pos <= 24 QUALIFY row_number() OVER (PARTITION BY query_id, sha256(text) ORDER BY pos) = 1),
w AS (SELECT *, {sql_words('text')} AS ws FROM f), p AS (SELECT *, len(ws) AS n, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS p FROM w WHERE len(ws) > 0),
c AS (SELECT *, least(n, CASE WHEN p = 0 THEN 600 ELSE 200 END) AS want FROM p WHERE p = 0 OR p <= 24),
b AS (SELECT *, greatest(0, least(want, 1500 - coalesce(sum(want) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS tokens FROM c)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS position, CASE WHEN p = 0 THEN 'expanded' ELSE 'snippet' END AS kind, frame_id, tokens::BIGINT AS tokens, sha256(array_to_string(list_slice(ws, 1, tokens), ' ')) AS digest FROM b WHERE tokens > 0""")
def context_budget(spark, d):
    rows = T.read(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("frame_id"), F.col("n_chars").cast("double").alias("score"), F.col("text").alias("preview"))
    items = context.build_context(rows, preview_bytes=1 << 30)
    return items.select("query_id", "position", "kind", "frame_id", F.col("tokens").cast("bigint").alias("tokens"), F.sha2("text", 256).alias("digest"))


@query("""WITH items AS (SELECT user_id AS query_id, event_id % 30 AS frame_id, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS position FROM events),
f AS (SELECT * FROM items WHERE position <= 10 QUALIFY row_number() OVER (PARTITION BY query_id, frame_id ORDER BY position) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, frame_id) AS citation, frame_id, round(score, 6) AS score FROM f""")
def citations(spark, d):
    e = T.read(spark, d, "events")
    items = e.select(F.col("user_id").alias("query_id"), (F.col("event_id") % 30).alias("frame_id"), F.col("value").alias("score"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("position"))
    return context.citations(items, T.frames(spark, d)).select("query_id", "citation", "frame_id", F.round("score", 6).alias("score"))


def _recalled(spark, d) -> tuple[DataFrame, DataFrame]:
    """Each conversation's first user turn as a query, the others as its items."""
    turns = T.read(spark, d, "conversations")
    first = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("turn"))
    asked = turns.join(first, ["conv_id", "turn"]).select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    items = turns.join(first, ["conv_id", "turn"], "left_anti").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), (1 / (1 + F.col("turn"))).alias("score"), "text")
    return items, asked.dropDuplicates(["query_id"])


# ---- facts

LOG = "log AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'upsert' END AS op, 'user:' || user_id AS entity, 'k' || (event_id % 3) AS attribute, props AS value, event_id AS id, floor(epoch(ts))::BIGINT * 1000 AS ts_ms FROM events)"
LIVES = "lives AS (SELECT *, sum(CASE WHEN op = 'remove' THEN 1 ELSE 0 END) OVER (PARTITION BY entity, attribute ORDER BY seq ROWS UNBOUNDED PRECEDING) AS life FROM log)"
VERSIONS = "versions AS (SELECT *, row_number() OVER (PARTITION BY entity, attribute, life ORDER BY seq) AS version FROM lives WHERE op = 'upsert')"


@query(f"WITH {LOG}, {LIVES}, {VERSIONS} SELECT seq, entity, attribute, version FROM versions")
def fact_versions(spark, d):
    return facts.versions(T.fact_log(spark, d)).select("seq", "entity", "attribute", "version")


_LATEST = "SELECT v.entity, v.attribute, v.value, v.id, v.version FROM versions v JOIN (SELECT entity, attribute, max(seq) AS seq FROM log GROUP BY ALL) l USING (entity, attribute, seq)"


@query(f"WITH {LOG}, {LIVES}, {VERSIONS} {_LATEST}")
def fact_latest(spark, d):
    return facts.latest(T.fact_log(spark, d)).select("entity", "attribute", "value", "id", "version")


@query(f"WITH {LOG.replace('FROM events)', 'FROM events WHERE floor(epoch(ts))::BIGINT * 1000 <= 1705000000000)')}, {LIVES}, {VERSIONS} {_LATEST}")
def fact_asof(spark, d):
    return facts.latest(T.fact_log(spark, d), 1_705_000_000_000).select("entity", "attribute", "value", "id", "version")


_REVISIONS = "SELECT event_id AS id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS supersedes FROM events"


@query(f"WITH RECURSIVE r AS ({_REVISIONS}), chain AS (SELECT id, supersedes, 0 AS step FROM r WHERE id = (SELECT max(event_id) FROM events WHERE user_id = 7) UNION ALL SELECT r.id, r.supersedes, step + 1 FROM chain JOIN r ON r.id = chain.supersedes) SELECT id, step FROM chain")
def fact_history(spark, d):
    e = T.read(spark, d, "events")
    newest = e.filter("user_id = 7").agg(F.max("event_id")).first()[0]
    revisions = e.select(F.col("event_id").alias("id"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("supersedes"))
    return facts.history(revisions, newest).select("id", "step")


@query(f"WITH RECURSIVE r AS ({_REVISIONS}), chain AS (SELECT id AS head, id, supersedes, 0 AS step FROM r WHERE id NOT IN (SELECT supersedes FROM r WHERE supersedes IS NOT NULL) UNION ALL SELECT chain.head, r.id, r.supersedes, step + 1 FROM chain JOIN r ON r.id = chain.supersedes) SELECT head, id, step FROM chain")
def fact_histories(spark, d):
    e = T.read(spark, d, "events")
    return facts.histories(e.select(F.col("event_id").alias("id"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("supersedes")))


# ---- store

MUTATIONS = """puts AS (SELECT event_id AS frame_id, props AS text FROM events), gone AS (SELECT DISTINCT event_id // 2 AS frame_id FROM events WHERE event_id % 7 = 3),
links AS (SELECT event_id - 5 AS old, event_id AS new FROM events WHERE event_id % 11 = 5 AND event_id % 7 <> 3)"""


@query(f"WITH {MUTATIONS} SELECT p.frame_id, CASE WHEN g.frame_id IS NULL THEN 0 ELSE 1 END AS status, b.old AS supersedes, a.new AS superseded_by, p.text FROM puts p LEFT JOIN gone g USING (frame_id) LEFT JOIN links a ON a.old = p.frame_id LEFT JOIN links b ON b.new = p.frame_id")
def mutation_fold(spark, d):
    return store.fold_mutations(T.mutations(spark, d)).select("frame_id", "status", "supersedes", "superseded_by", "text")


@query("SELECT 2 * event_id + 1 AS seq, 'unknown frame' AS error FROM events WHERE event_id % 7 = 3 AND event_id // 2 NOT IN (SELECT event_id FROM events) UNION ALL SELECT 2 * event_id + 1, 'unknown frame' FROM events WHERE event_id % 11 = 5 AND event_id % 7 <> 3 AND event_id - 5 NOT IN (SELECT event_id FROM events)")
def mutation_errors(spark, d):
    return store.mutation_errors(T.mutations(spark, d))


@query("WITH RECURSIVE l AS (SELECT event_id AS old, event_id + 3 AS new FROM events WHERE event_id % 4 <> 0), walk AS (SELECT old AS root, new AS tip, 1 AS hops FROM l WHERE old NOT IN (SELECT new FROM l) UNION ALL SELECT root, l.new, hops + 1 FROM walk JOIN l ON l.old = walk.tip) SELECT root, arg_max(tip, hops) AS tip, max(hops) AS hops FROM walk GROUP BY root")
def supersede_tip(spark, d):
    e = T.read(spark, d, "events").filter("event_id % 4 <> 0")
    return store.supersede_tips(e.select(F.col("event_id").alias("old"), (F.col("event_id") + 3).alias("new")))


@query("SELECT doc_id AS frame_id FROM documents WHERE doc_id % 97 = 5")
def sha256_verify(spark, d):
    frames = T.frames(spark, d).withColumn("sha256", F.when(F.col("frame_id") % 97 == 5, "0").otherwise(hashing.sha256(F.col("text"))))
    return store.verify(frames)


@query(f"WITH {FRAMES} SELECT count(*) AS frames, count(*) FILTER (status = 0 AND superseded_by IS NULL) AS live, count(*) FILTER (status <> 0) AS deleted, count(*) FILTER (superseded_by IS NOT NULL) AS superseded, sum(octet_length(encode(text)))::BIGINT AS total_bytes, sum(CASE WHEN status <> 0 OR superseded_by IS NOT NULL THEN octet_length(encode(text)) ELSE 0 END)::BIGINT AS dead_bytes, round(sum(CASE WHEN status <> 0 OR superseded_by IS NOT NULL THEN octet_length(encode(text)) ELSE 0 END) / sum(octet_length(encode(text))), 6) AS dead_share FROM frames")
def dead_payload(spark, d):
    return store.payload_stats(T.frames(spark, d))


@query("""WITH g AS (SELECT event_id, event_id % 5 <> 0 AS enabled, event_id % 29 = 0 AS force, event_id AS flush, 1000000 + event_id * 100 AS now_ms, event_id * 90 AS last_done_ms, 1000000 + event_id * 99 AS last_write_ms, event_id * 1000 AS dead_bytes, 5000 * 1000 AS total_bytes FROM events)
SELECT event_id, CASE WHEN NOT enabled THEN 'disabled' WHEN force THEN 'run' WHEN flush % 4 <> 0 THEN 'cadence' WHEN now_ms - last_done_ms < 300000 THEN 'cooldown' WHEN now_ms - last_write_ms < 15000 THEN 'not idle' WHEN dead_bytes < 67108864 AND dead_bytes / total_bytes < 0.25 THEN 'below threshold' ELSE 'run' END AS outcome FROM g""")
def maintenance_gate(spark, d):
    i = F.col("event_id")
    rows = T.read(spark, d, "events").select("event_id", (i % 5 != 0).alias("enabled"), (i % 29 == 0).alias("force"), i.alias("flush"), (1_000_000 + i * 100).alias("now_ms"), (i * 90).alias("last_done_ms"), (1_000_000 + i * 99).alias("last_write_ms"), (i * 1000).alias("dead_bytes"), F.lit(5_000_000).alias("total_bytes"))
    return rows.select("event_id", store.MaintenanceGate(every=4).outcome().alias("outcome"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS frame_id, doc_id AS ts_ms, sha256(text) AS sha256, lang || ',' || source AS labels FROM documents")
def frame_append(spark, d):
    docs = T.read(spark, d, "documents")
    new = docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("ts_ms"), "text", F.create_map(F.lit("labels"), F.concat_ws(", ", "lang", "source")).alias("metadata"))
    empty = spark.createDataFrame([], "frame_id long, ts_ms long, text string, sha256 string, status int, kind string, metadata map<string,string>, labels array<string>, supersedes long, superseded_by long")
    return store.append_frames(empty, new).select("frame_id", "ts_ms", "sha256", F.array_join("labels", ",").alias("labels"))


# ---- chunks and ingest


@query(f"""WITH w AS (SELECT doc_id, text, {sql_words('text')} AS ws FROM documents), n AS (SELECT *, len(ws) AS n FROM w WHERE len(ws) > 0),
r AS (SELECT doc_id, text, ws, n, unnest(generate_series(0, CASE WHEN n <= 100 THEN 0 ELSE ceil((n - 100) / 90.0)::BIGINT END)) AS chunk FROM n)
SELECT doc_id AS frame_id, chunk, chunk * 90 AS start, least(chunk * 90 + 100, n) AS "end", sha256(CASE WHEN n <= 100 THEN text ELSE array_to_string(list_slice(ws, chunk * 90 + 1, least(chunk * 90 + 100, n)), ' ') END) AS digest FROM r""")
def chunk_whitespace(spark, d):
    cut = chunks.chunk_words(T.frames(spark, d), 100, 10)
    return cut.select("frame_id", F.col("chunk").cast("bigint").alias("chunk"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.sha2("text", 256).alias("digest"))


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(\\r\\n|\\r|\\n)$', ''), '\\r\\n|\\r|\\n') AS lines FROM documents WHERE text <> ''),
c AS (SELECT doc_id, lines, list_transform(lines, lambda x: greatest(1, len({sql_words('x')}))) AS costs FROM t), sums AS (SELECT doc_id, lines, [0] || list_transform(generate_series(1, len(costs)), lambda i: list_sum(costs[1:i])::BIGINT) AS s, len(costs) AS n FROM c),
walk AS (SELECT doc_id, s, n, 0 AS start, greatest(1, len(list_filter(s, lambda x: x <= 100)) - 1) AS stop FROM sums
  UNION ALL SELECT doc_id, s, n, b, greatest(b + 1, len(list_filter(s, lambda x: x <= s[b + 1] + 100)) - 1) FROM (SELECT doc_id, s, n, greatest(len(list_filter(s, lambda x: x < s[stop + 1] - 20)), start + 1) AS b FROM walk WHERE stop < n))
SELECT 'd/' || doc_id || '.cpp' AS relative_path, (start + 1)::INT AS line_start, stop::INT AS line_end, (w.s[stop + 1] - w.s[start + 1])::INT AS token_estimate, sha256(array_to_string(lines[start + 1 : stop], chr(10))) AS digest
FROM walk w JOIN sums USING (doc_id) WHERE trim(array_to_string(lines[start + 1 : stop], ''), E' \\t\\r\\n\\f\\x0B') <> ''""")
def line_chunks(spark, d):
    files = T.read(spark, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".cpp")).alias("relative_path"), "text")
    return chunks.chunk_lines(files, 100, 20).select("relative_path", "line_start", "line_end", "token_estimate", F.sha2("text", 256).alias("digest"))


@query("SELECT page_id, lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(generate_series(1, octet_length(encode(url))), lambda i: ('0x' || hex(encode(url)[i:i]))::INT::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0') AS digest FROM pages")
def fnv64(spark, d):
    return T.read(spark, d, "pages").select("page_id", hashing.fnv1a64(F.col("url")).alias("digest"))


@query("SELECT 'site/' || page_id || '.html' AS relative_path, octet_length(encode(html))::BIGINT AS size_bytes FROM pages WHERE page_id % 10 = 4")
def file_diff(spark, d):
    now = chunks.file_digests(T.files(spark, d))
    before = chunks.file_digests(T.files(spark, d).withColumn("text", F.when(F.col("page_id") % 10 == 4, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))))
    return chunks.changed(now, before).select("relative_path", "size_bytes")


@query("SELECT doc_id::VARCHAR AS chunk_id FROM documents WHERE doc_id % 4 <> 1")
def resume_skip(spark, d):
    rows = T.frames(spark, d).select(F.col("frame_id").cast("string").alias("chunk_id"), "frame_id")
    return chunks.not_processed(rows.select("chunk_id"), rows.filter("frame_id % 4 = 1"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'indexed' WHEN doc_id % 7 = 0 THEN 'updated' ELSE 'unchanged' END AS status FROM documents) GROUP BY status")
def refresh_status(spark, d):
    fresh = T.frames(spark, d).select(F.col("frame_id").cast("string").alias("entity"), F.sha2("text", 256).alias("structural_hash"), "frame_id")
    stored = fresh.filter("frame_id % 3 <> 0").withColumn("structural_hash", F.when(F.col("frame_id") % 7 == 0, "old").otherwise(F.col("structural_hash")))
    return chunks.refresh_status(fresh, stored).groupBy("status").agg(F.count("*").alias("n"))


_ENTRIES = "SELECT CASE WHEN doc_id % 5 = 0 THEN 'Saved/' WHEN doc_id % 5 = 1 THEN 'Source/A/' ELSE 'src/' END || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.CPP' WHEN doc_id % 3 = 1 THEN '.h' ELSE '.txt' END AS relative_path, n_chars AS size_bytes FROM documents"


@query(f"SELECT relative_path, size_bytes FROM ({_ENTRIES}) WHERE NOT starts_with(relative_path, 'Saved/') AND NOT suffix(relative_path, '.txt')")
def source_scan(spark, d):
    i = F.col("doc_id")
    path = F.concat(F.when(i % 5 == 0, "Saved/").when(i % 5 == 1, "Source/A/").otherwise("src/"), i.cast("string"), F.when(i % 3 == 0, ".CPP").when(i % 3 == 1, ".h").otherwise(".txt"))
    return filter_entries(T.read(spark, d, "documents").select(path.alias("relative_path"), F.col("n_chars").alias("size_bytes")))


# ---- maintenance


@query("SELECT event_id % 997 AS frame_id, count(*) AS accesses, min(floor(epoch(ts))::BIGINT * 1000) AS first_ms, max(floor(epoch(ts))::BIGINT * 1000) AS last_ms FROM events GROUP BY 1")
def access_stats(spark, d):
    return maintain.access_stats(T.access_log(spark, d))


NOW = 1_706_700_000_000
SCORED = f"""acc AS (SELECT event_id % 997 AS frame_id, count(*) AS n, max(floor(epoch(ts))::BIGINT * 1000) AS last_ms FROM events GROUP BY 1),
scored AS (SELECT doc_id AS frame_id, lang, source, {NOW} - (1704000000000 + doc_id * 3600000) AS age_ms, (0.3 * exp(-greatest({NOW} - (1704000000000 + doc_id * 3600000), 0) / 3600000.0 / 168) + 0.4 * coalesce(least(1.0, ln(n + 1) / 5.0), 0) + 0.3 * coalesce(exp(-greatest({NOW} - last_ms, 0) / 3600000.0 / 24), 0)) / 1.0 AS score FROM documents LEFT JOIN acc ON acc.frame_id = doc_id)"""


def _scored(spark, d) -> DataFrame:
    acc = maintain.access_stats(T.access_log(spark, d))
    docs = T.read(spark, d, "documents").select(F.col("doc_id").alias("frame_id"), "lang", "source", (F.lit(NOW) - (1_704_000_000_000 + F.col("doc_id") * 3_600_000)).alias("age_ms")).join(acc, "frame_id", "left")
    return docs.withColumn("score", maintain.importance(F.col("age_ms"), F.col("accesses"), F.lit(NOW) - F.col("last_ms")))


@query(f"WITH {SCORED} SELECT frame_id, round(score, 6) AS score FROM scored")
def importance(spark, d):
    return _scored(spark, d).select("frame_id", F.round("score", 6).alias("score"))


@query(f"WITH {SCORED} SELECT frame_id, CASE WHEN age_ms < 604800000 THEN 'full' WHEN age_ms < 2592000000 THEN 'gist' ELSE 'micro' END AS by_age, CASE WHEN round(score, 9) >= 0.6 THEN 'full' WHEN round(score, 9) >= 0.3 THEN 'gist' ELSE 'micro' END AS by_importance FROM scored")
def tier_select(spark, d):
    return _scored(spark, d).select("frame_id", maintain.tier("age", F.col("age_ms")).alias("by_age"), maintain.tier("importance", F.col("age_ms"), F.round("score", 9)).alias("by_importance"))


@query(f"WITH {SCORED} SELECT lang, source, count(*) AS frames, round(avg(score), 6) AS mean_score FROM scored GROUP BY ROLLUP (lang, source)")
def importance_rollup(spark, d):
    return maintain.importance_rollup(_scored(spark, d), ["lang", "source"])


@query()
def surrogate_mmr(spark, d):
    return maintain.summarize(maintain.summary_candidates(T.frames(spark, d)).select("frame_id", "text"))


_SEGMENTS = r"""flat AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS text FROM documents),
segs AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '[^.!?;\n]*[.!?;\n]|[^.!?;\n]+$'))) AS s FROM flat), good AS (SELECT doc_id, s, list_filter(regexp_extract_all(lower(s), '[0-9a-z]+'), lambda x: length(x) > 2) AS tk FROM segs WHERE s <> '')"""


@query(f"WITH {_SEGMENTS} SELECT doc_id AS frame_id, count(*) AS segments, round(sum(least(len(tk), 40) * (CASE WHEN len(tk) < 4 THEN 0.25 ELSE 1 END) * (CASE WHEN len(tk) > 80 THEN 0.7 ELSE 1 END) + (CASE WHEN regexp_matches(s, '[0-9]') THEN 6 ELSE 0 END) + (CASE WHEN contains(s, ':') THEN 4 ELSE 0 END) + (CASE WHEN contains(s, '`') THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(s, '^[-*]') THEN 2 ELSE 0 END) + (CASE WHEN len(tk) > 0 THEN len(list_distinct(tk)) / len(tk) * 3.0 ELSE 0 END))::DOUBLE, 5) AS score FROM good GROUP BY doc_id")
def segment_score(spark, d):
    flat = F.trim(F.regexp_replace("text", t.WHITE, " "))
    rows = T.frames(spark, d).select("frame_id", F.explode(maintain.segments(flat)).alias("s"))
    return rows.groupBy("frame_id").agg(F.count("*").alias("segments"), F.round(F.sum(maintain.segment_score(F.col("s"))), 5).alias("score"))


@query("""WITH tk AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[0-9a-z]+'), lambda x: length(x) > 2)) AS s FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END, 6) AS similarity FROM tk a JOIN tk b ON b.item_id = a.item_id + 1""")
def jaccard_pairs(spark, d):
    rows = T.read(spark, d, "benchmark").select("item_id", F.array_distinct(maintain.scoring_tokens(F.col("text"))).alias("s"))
    pairs = rows.join(rows.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("o")), "item_id")
    return pairs.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.round(maintain.jaccard(F.col("s"), F.col("o")), 6).alias("similarity"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS first_ts, floor(epoch(max(ts)))::BIGINT AS last_ts, count(*) AS events FROM s GROUP BY user_id, n""")
def session_windows(spark, d):
    e = T.read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return maintain.sessions(e).select("user_id", F.unix_seconds("first_ts").alias("first_ts"), F.unix_seconds("last_ts").alias("last_ts"), "events")


# ---- graph documents and enrichment

_ASSET = "CASE l_orderkey % 3 WHEN 0 THEN 'GA_' WHEN 1 THEN 'W_' ELSE 'BP_' END || l_orderkey"


@query(f"SELECT 'bp:' || {_ASSET} AS entity, CASE l_orderkey % 3 WHEN 0 THEN 'gameplay_ability' WHEN 1 THEN 'widget' ELSE 'actor_blueprint' END AS kind, 'Actor' AS parent_class_hint, count(*) + 1 AS node_count, count(*) AS link_count, array_to_string(list_sort(list(DISTINCT 'Part' || l_partkey)), ',') AS calls, array_to_string(list_sort(list(DISTINCT 'Supplier' || l_suppkey)), ',') AS call_owners FROM lineitem GROUP BY l_orderkey")
def bp_facts(spark, d):
    f = graph.structural_facts(T.graph_documents(spark, d))
    return f.select("entity", "kind", "parent_class_hint", F.col("node_count").cast("bigint").alias("node_count"), F.col("link_count").cast("bigint").alias("link_count"), F.array_join("calls", ",").alias("calls"), F.array_join("call_owners", ",").alias("call_owners"))


@query(f"SELECT 'bp:' || {_ASSET} AS entity, 'Begin' AS event, string_agg('Part' || l_partkey, ' → ' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (n < 16) AS chain FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) GROUP BY l_orderkey")
def exec_chain(spark, d):
    f = graph.structural_facts(T.graph_documents(spark, d))
    return f.select("entity", F.inline("exec_chains"))


@query("SELECT CASE l_orderkey % 3 WHEN 0 THEN 'gameplay_ability' WHEN 1 THEN 'widget' ELSE 'actor_blueprint' END AS kind, count(DISTINCT l_orderkey) AS documents FROM lineitem GROUP BY 1")
def kind_distribution(spark, d):
    return graph.kind_distribution(graph.structural_facts(T.graph_documents(spark, d)))


@query("WITH c AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1) SELECT doc_id, 0 AS chunk, CASE WHEN n <= 5 THEN '' ELSE 'EventGraph' END AS graph, CASE WHEN n <= 5 THEN 15 + 8 * n ELSE 58 END AS tokens FROM c UNION ALL SELECT doc_id, k::INT, 'EventGraph', 6 + 9 * least(6, n - 5 - 6 * (k - 1)) FROM (SELECT doc_id, n, unnest(generate_series(1, ceil((n - 5) / 6.0)::BIGINT)) AS k FROM c WHERE n > 5)")
def graph_chunks(spark, d):
    return graph.chunk(graph.compress(T.graph_documents(spark, d)), 60).drop("text")


@query("SELECT l_orderkey AS doc_id, 'Patched EventGraph: 1 nodes added, 1 links added' AS summary, count(*) + 2 AS nodes, count(*) + 1 AS links, '0' AS link_from, true AS known FROM lineitem GROUP BY l_orderkey")
def graph_patch(spark, d):
    docs = T.graph_documents(spark, d)
    intent = '{"graphs": [{"name": "EventGraph", "add_nodes": [{"ref": "b", "type": "Branch"}], "add_links": [{"from": "existing:start", "from_pin": "then", "to": "b", "to_pin": "execute"}]}]}'
    made = graph.patch(docs, docs.select("doc_id", F.lit(intent).alias("intent")))
    shape = "struct<graphs:array<struct<nodes:array<struct<node_guid:string>>,links:array<struct<from_node_guid:string,to_node_guid:string>>>>>"
    g = F.from_json("json", shape)["graphs"][0]
    last = F.element_at(g["links"], -1)
    return made.select("doc_id", "summary", F.size(g["nodes"]).cast("bigint").alias("nodes"), F.size(g["links"]).cast("bigint").alias("links"), last["from_node_guid"].alias("link_from"), (F.element_at(g["nodes"], -1)["node_guid"] == last["to_node_guid"]).alias("known"))


@query("SELECT 'f' || doc_id || '.h' AS relative_path, source || '.h' AS include FROM documents UNION ALL SELECT 'f' || doc_id || '.h', lang FROM documents")
def includes_extract(spark, d):
    text = F.concat(F.lit('#include "'), "source", F.lit('.h"\n  #include <'), "lang", F.lit(">\nint x;\n"))
    return enrich.includes(T.read(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".h")).alias("relative_path"), text.alias("text")))


@query("""SELECT 'cpp:UDoc' || doc_id AS entity, unnest(['kind', 'specifiers', 'inherits']) AS attribute, unnest(['uclass', 'Blueprintable', 'UObject']) AS value FROM documents
UNION ALL SELECT 'cpp:UDoc' || doc_id || '.' || source, unnest(['type', 'specifiers', 'category', 'kind']), unnest(['float', 'EditAnywhere', lang, 'uproperty']) FROM documents
UNION ALL SELECT 'cpp:UDoc' || doc_id || '::Run', unnest(['returns', 'specifiers', 'kind']), unnest(['void', 'BlueprintCallable', 'ufunction']) FROM documents""")
def rule_facts(spark, d):
    key = F.col("doc_id").cast("string")
    text = F.concat(F.lit("UCLASS(Blueprintable)\nclass UDoc"), key, F.lit(' : public UObject {\n  UPROPERTY(EditAnywhere, Category = "'), "lang", F.lit('")\n  float '), "source", F.lit(" = 1;\n\n  UFUNCTION(BlueprintCallable)\n  void Run(int A);\n};\n"))
    rows = T.read(spark, d, "documents").select(key.alias("chunk_id"), F.concat(F.lit("a/"), key, F.lit(".h")).alias("relative_path"), F.lit("").alias("symbol"), F.lit(1).alias("line_start"), F.lit(8).alias("line_end"), text.alias("text"))
    return enrich.rule_facts(rows).select("entity", "attribute", "value")


@query("SELECT 'bp:' || doc_id AS entity, CASE WHEN doc_id % 4 = 0 THEN 'about ' || source ELSE '' END AS purpose, doc_id % 8 = 0 AS purpose_stale FROM documents")
def purposes_join(spark, d):
    docs = T.read(spark, d, "documents")
    rows = docs.select(F.concat(F.lit("bp:"), F.col("doc_id").cast("string")).alias("entity"), F.sha2("text", 256).alias("structural_hash"), "doc_id", "source")
    own = rows.filter("doc_id % 4 = 0").select("entity", F.concat(F.lit("about "), "source").alias("purpose"), F.when(F.col("doc_id") % 8 == 0, "old").otherwise(F.col("structural_hash")).alias("structural_hash"))
    return enrich.with_purposes(rows, own).select("entity", "purpose", "purpose_stale")
