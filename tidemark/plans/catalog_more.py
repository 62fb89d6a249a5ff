"""Further queries: text measures, answers, reranking, ingest, lookups and models, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.functions import text as t
from tidemark.operators import answers, chunks, context, enrich, evaluate, facts, graph, maintain, rerank, store, vector_search
from tidemark.plans import tables as T
from tidemark.plans.catalog import EAV, FRAMES, lower, query, quoted, sql_any, sql_entities, sql_stem, sql_words
from tidemark.streaming import streams


def _pick(key: str, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _sql_pick(key: str, values: list[str]) -> str:
    return f"([{quoted(values)}])[{key} % {len(values)} + 1]"


def _glue(*parts: str | Column) -> Column:
    """Literal texts and columns, one after another; columns are given as ``@name``."""
    return F.concat(*[p if isinstance(p, Column) else F.col(p[1:]).cast("string") if p.startswith("@") else F.lit(p) for p in parts])


# ---- text measures


@query("""WITH c AS (SELECT doc_id, text, unnest(generate_series(0, least(length(text), 100))) AS n FROM documents),
k AS (SELECT doc_id, text, max(n) AS n FROM c WHERE octet_length(encode(left(text, n))) <= 100 GROUP BY ALL)
SELECT doc_id, left(text, n) || CASE WHEN octet_length(encode(left(text, n))) < least(100, octet_length(encode(text))) THEN chr(65533) ELSE '' END AS head FROM k""")
def truncate_bytes(spark, d):
    return T.read(spark, d, "documents").select("doc_id", t.truncate_bytes(F.col("text"), 100).alias("head"))


_MONTHS = [m.capitalize() for m in t.MONTHS]


@query("SELECT o_orderkey, array_to_string(CASE WHEN month(o_orderdate) = 5 THEN [strftime(o_orderdate, '%-d May %Y'), strftime(o_orderdate, 'May %-d, %Y'), strftime(o_orderdate, '%-d May %Y'), strftime(o_orderdate, 'May %-d, %Y')] ELSE [strftime(o_orderdate, '%-d %B %Y'), strftime(o_orderdate, '%b %-d, %Y')] END || [strftime(o_orderdate, '%Y-%m-%d')], '|') AS dates FROM orders")
def date_literals(spark, d):
    day = F.col("o_orderdate")
    name = F.element_at(F.array(*map(F.lit, _MONTHS)), F.month(day))
    number, year = F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    text = _glue("Sent ", number, " ", name, " ", year, ", seen ", F.left(name, F.lit(3)), " ", number, ", ", year, " and due ", F.date_format(day, "yyyy-MM-dd"), ".")
    return T.read(spark, d, "orders").select("o_orderkey", F.array_join(t.date_literals(text), "|").alias("dates"))


@query(f"SELECT conv_id, turn, {sql_any('text', t.TENTATIVE)} AS tentative, {sql_any('text', t.DISTRACTORS)} AS distractor, regexp_matches(text, '(moved|move) to [A-Z][a-z]+') AS moved FROM (SELECT conv_id, turn, text || CASE turn % 5 WHEN 0 THEN ' target date' WHEN 1 THEN ' the weekly report' WHEN 2 THEN ' moved to Rome' WHEN 3 THEN ' move to rome' ELSE '' END AS text FROM conversations)")
def text_predicates(spark, d):
    rows = T.read(spark, d, "conversations")
    x = F.concat("text", _pick("turn", [" target date", " the weekly report", " moved to Rome", " move to rome", ""]))
    return rows.select("conv_id", "turn", t.is_tentative(x).alias("tentative"), t.is_distractor(x).alias("distractor"), t.moved_to_place(x).alias("moved"))


@query("SELECT event_id, len(regexp_extract_all(props, '[^\\s{}\\[\\],:\"][\\s{}\\[\\],:\"]')) + 1 AS tokens FROM events")
def json_tokens(spark, d):
    return T.read(spark, d, "events").select("event_id", t.json_tokens(F.col("props")).cast("bigint").alias("tokens"))


_FLAGS = ["1", "TRUE", "Yes", "on", "0", "false", "off", "", "2"]


@query(f"SELECT event_id, coalesce(lower(v) IN ('1', 'true', 'yes', 'on'), false) AS flag FROM (SELECT event_id, CASE WHEN event_id % 10 = 9 THEN NULL ELSE {_sql_pick('event_id', _FLAGS)} END AS v FROM events)")
def flag(spark, d):
    return T.read(spark, d, "events").select("event_id", t.flag(F.when(F.col("event_id") % 10 != 9, _pick("event_id", _FLAGS))).alias("flag"))


_EXTENSIONS = ["h", "HPP", "cpp", "inl", "c", "py", "JS", "json", "bpl_json", "cs", "md", "txt", "cc", "inc"]


@query(f"SELECT doc_id, CASE lower({_sql_pick('doc_id', _EXTENSIONS)}) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in t.LANGUAGES.items()) + " ELSE 'text' END AS language FROM documents")
def language_detect(spark, d):
    return T.read(spark, d, "documents").select("doc_id", t.language_of(_glue("a.b/c", "@doc_id", ".", _pick("doc_id", _EXTENSIONS))).alias("language"))


@query(f"WITH {EAV} SELECT id, entity || ' ' || attribute || ' ' || value AS preview FROM eav")
def fact_preview(spark, d):
    return T.eav(spark, d).select("id", facts.preview().alias("preview"))


_GUIDS = ["0123456789abcdef", "0123-4567-89AB-CDEF", "0123456789abcde", "{0123456789abcdef}", "then", "----------------"]


@query(f"SELECT event_id, regexp_matches(v, '^[0-9A-Fa-f-]{{16,}}$') AND length(replace(v, '-', '')) >= 16 AS guid FROM (SELECT event_id, {_sql_pick('event_id', _GUIDS)} AS v FROM events)")
def guid_like(spark, d):
    return T.read(spark, d, "events").select("event_id", enrich.looks_like_guid(_pick("event_id", _GUIDS)).alias("guid"))


@query("SELECT event_id, event_id % 4 = 1 AS internal FROM events")
def internal_payload(spark, d):
    text = F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("OWN1"), "props")).when(F.col("event_id") % 4 == 2, F.lit(None)).otherwise(F.concat(F.lit("own1 OWN1"), "props"))
    return T.read(spark, d, "events").select("event_id", store.is_internal(text, ("OWN1", "OWN2")).alias("internal"))


@query("SELECT doc_id, doc_id % 3 <> 1 AND doc_id % 2 = 0 AS is_user FROM documents")
def user_frame(spark, d):
    i = F.col("doc_id")
    first = F.when(i % 3 == 0, F.create_map(F.lit("source_kind"), F.lit("file"))).when(i % 3 == 1, F.create_map(F.lit("lang"), "lang")).otherwise(F.create_map(F.lit("chunk_id"), F.lit("x")))
    meta = F.when(i % 2 == 1, F.map_concat(first, F.create_map(F.lit("enricher_kind"), F.lit("rules")))).otherwise(first)
    return T.read(spark, d, "documents").select("doc_id", store.is_user_frame(meta).alias("is_user"))


_GRAPH_CHUNKS = ['"pin_id": 1, "direction": 2', '"cast_target": "X"', 'K2Node_Event "title": "T"', "K2Node_Event", '"blueprint": "a", "asset_path": "b", "asset_name": "c", "asset_class": "d"', '"blueprint": "a", "asset_path": "b", "asset_name": "c", "asset_kind": "d", "pin_id": 1', ""]


@query("SELECT event_id, event_id % 7 IN (1, 2, 4) AS useful FROM events")
def useful_graph_chunk(spark, d):
    return T.read(spark, d, "events").select("event_id", enrich.useful_graph_chunk(_pick("event_id", _GRAPH_CHUNKS)).alias("useful"))


# ---- relevance, answers and reranking


def sql_terms(c: str) -> str:
    return f"list_distinct(list_transform(list_filter({sql_words(lower(c))}, lambda w: w NOT IN ({quoted(t.TERM_STOP_WORDS)})), lambda w: {sql_stem('w')}))"


def sql_years(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all({c}, '[0-9A-Za-z]+'), lambda r: regexp_matches(r, '^(19|20)[0-9]{{2}}$')))"


_PACK = "pack AS (SELECT item_id, text || ' about person' || item_id % 9 || ' in ' || 2018 + item_id % 5 AS text FROM benchmark)"


@query(f"""WITH {_PACK}, {sql_entities('pack', 'item_id')}, e AS (SELECT item_id, list(w) AS ents FROM entities GROUP BY item_id),
r AS (SELECT item_id, {sql_terms('text')} AS terms, coalesce(ents, []) AS ents, {sql_years('text')} AS years FROM pack LEFT JOIN e USING (item_id)),
p AS (SELECT q.item_id AS query_id, q.terms AS a, i.terms AS b, len(list_intersect(q.terms, i.terms)) AS n, q.ents AS qe, len(list_intersect(q.ents, i.ents)) AS ne, q.years AS qy, i.years AS iy, len(list_intersect(q.years, i.years)) AS ny FROM r q JOIN r i ON i.item_id = q.item_id + 1)
SELECT query_id, round(0.5 + CASE WHEN len(a) > 0 AND len(b) > 0 THEN 0.7 * n / len(a) + 0.3 * n / len(b) ELSE 0 END + CASE WHEN len(qe) > 0 THEN 0.95 * ne / len(qe) - CASE WHEN ne = 0 THEN 0.7 ELSE 0 END ELSE 0 END
  + CASE WHEN len(qy) > 0 THEN 1.45 * ny / len(qy) - CASE WHEN ny = 0 AND len(iy) > 0 THEN 1.35 ELSE 0 END ELSE 0 END, 6)::DOUBLE AS relevance FROM p""")
def relevance(spark, d):
    i = F.col("item_id")
    pack = T.read(spark, d, "benchmark").select("item_id", _glue("@text", " about person", (i % 9).cast("string"), " in ", (i % 5 + 2018).cast("string")).alias("text"))
    pairs = pack.join(pack.select((i - 1).alias("item_id"), F.col("text").alias("item")), "item_id")
    return pairs.select(i.alias("query_id"), F.round(answers.relevance(F.col("text"), F.col("item"), F.lit(0.5)), 6).alias("relevance"))


_PEOPLE, _PLACES, _FOODS, _PETS = ["Alice Smith", "Bob O'Neil", "Carla Diaz", "Ann-Mary"], ["Oslo", "New York", "Lima"], ["peanuts", "milk", "sea food"], ["Rex", "Bella"]
_YEAR, _DAY, _DAY2 = "2019 + s_suppkey % 5", "1 + s_suppkey % 27", "2 + s_suppkey % 26"
_NOTE = f"""note AS (SELECT s_suppkey AS k, {_sql_pick('s_suppkey', _PEOPLE)} AS person, {_sql_pick('s_suppkey', _PLACES)} AS place, {_sql_pick('s_suppkey', _FOODS)} AS food, {_sql_pick('s_suppkey', _PETS)} AS pet,
  {_sql_pick('s_suppkey', _MONTHS)} || ' ' || {_YEAR} AS adopted, {_sql_pick('s_suppkey', _MONTHS)} || ' ' || {_DAY} || ', ' || {_YEAR} AS launch, {_sql_pick('s_suppkey', _MONTHS)} || ' ' || {_DAY2} || ', ' || {_YEAR} || ' at 9:30 AM' AS visit FROM supplier)"""


def _notes(spark, d) -> DataFrame:
    rows = T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), *[F.expr(f"cast({x} as string)").alias(n) for n, x in (("year", _YEAR), ("day", _DAY), ("day2", _DAY2))], _pick("s_suppkey", _MONTHS).alias("month"), *[_pick("s_suppkey", v).alias(n) for n, v in (("person", _PEOPLE), ("place", _PLACES), ("food", _FOODS), ("pet", _PETS))])
    text = _glue("@person", " owns deployment readiness. Someone moved to ", "@place", " last week. Take a flight to ", "@place", " now. She is allergic to ", "@food", ". One prefers short notes. There is a dog named ", "@pet", ", adopted in ", "@month", " ", "@year", ". The public launch is ", "@month", " ", "@day", ", ", "@year", ". You see the dentist on ", "@month", " ", "@day2", ", ", "@year", " at 9:30 AM.")
    return rows.select("query_id", F.lit(1).alias("position"), F.lit(0.5).alias("score"), text.alias("text"))


@query(f"""WITH {_NOTE} SELECT k AS query_id, unnest(['owner', 'owner', 'launch', 'appointment', 'city', 'flight', 'allergy', 'preference', 'pet', 'adopted', 'date']) AS kind,
unnest([person, person, launch, visit, place, place, 'allergic to ' || food, 'short notes', pet, adopted, launch]) AS value, unnest([1.1, 1.1, 1.05, 1.05, 0.95, 0.95, 0.9, 0.85, 0.9, 0.9, 0.7])::DOUBLE AS score FROM note""")
def answer_candidates(spark, d):
    notes = _notes(spark, d)
    return answers.candidates(notes, notes.select("query_id", F.lit("zzz").alias("query"))).select("query_id", "kind", "value", F.round("score", 6).alias("score"))


_ASKED = ["adopt a dog", "who owns it and when is the launch", "status update style", "any allergy", "flight plans", "where is she", "dentist time and date", "launch timeline", "the owner please", "purple elephants"]


@query(f"WITH {_NOTE} SELECT k AS query_id, ([pet || ' in ' || adopted, person || ' and ' || launch, 'short notes', 'allergic to ' || food, place, place, visit, launch, person, 'The public launch is ' || launch])[k % 10 + 1] AS answer FROM note")
def answer_by_kind(spark, d):
    notes = _notes(spark, d)
    return answers.extract_answers(notes, notes.select("query_id", _pick("query_id", _ASKED).alias("query")))


@query("""WITH r AS (SELECT s_suppkey AS query_id, unnest([0, 1, 2, 3, 4]) AS frame_id, unnest([0.55 / 2 + 0.25 / 3 + 1.95 + 0.3 + 1.6, -0.85 + 1.6, 0.55 + 0.25 * 2 / 4 + 1.95 + 0.3 + 0.1 - 0.75, -0.85, 0.55 / 2 + 0.25 / 3 + 1.95 + 0.3 - 1.1 - 0.4]) AS more FROM supplier),
c AS (SELECT query_id, frame_id, round(1 / (1 + (frame_id + query_id) % 5) + more, 6)::DOUBLE AS composite FROM r) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY composite DESC) AS rank, frame_id, composite FROM c""")
def rerank_places(spark, d):
    who = lambda n: _glue("person", ((F.col("query_id") + n) % 7).cast("string"))
    base = T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"))
    previews = F.array(F.concat(who(0), F.lit(" moved to Oslo")), F.concat(who(1), F.lit(" moved to Rome")), F.concat(F.lit("city move retrospective for "), who(0)), F.lit("nothing here"), F.concat(who(0), F.lit(" is allergic to peanuts")))
    rows = base.select("query_id", F.posexplode(previews).alias("frame_id", "preview")).withColumn("score", 1 / (1 + (F.col("frame_id") + F.col("query_id")) % 5)).withColumn("sources", F.array(F.lit("text")))
    rows = rows.withColumn("rank", (F.col("frame_id") + F.col("query_id")) % 5 + 1)
    asked = base.select("query_id", F.concat(F.lit("where did "), who(0), F.lit(" move")).alias("query"))
    return rerank.intent_rerank(rows, asked).select("query_id", F.col("rank").cast("bigint").alias("rank"), "frame_id", "composite")


_CONVERSED = """first AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id), asked AS (SELECT c.conv_id AS query_id, any_value(text) AS query FROM conversations c JOIN first USING (conv_id, turn) GROUP BY 1),
items AS (SELECT conv_id AS query_id, turn AS position, text FROM conversations c ANTI JOIN first USING (conv_id, turn))"""


_SENTENCES = f"""c AS (SELECT query_id, query, position, trim(regexp_replace(translate(text, '[]', ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text FROM items JOIN asked USING (query_id)),
s AS (SELECT query_id, query, position, unnest(list_transform(regexp_split_to_array(text, '[.!?\\n]'), lambda s: trim(s, E' \\t\\r\\f\\x0B'))) AS sentence, generate_subscripts(regexp_split_to_array(text, '[.!?\\n]'), 1) AS n FROM c WHERE text <> ''),
w AS (SELECT *, list_transform(list_filter({sql_words(lower('sentence'))}, lambda w: w NOT IN ({quoted(t.TERM_STOP_WORDS)})), lambda w: {sql_stem('w')}) AS own, {sql_terms('query')} AS terms FROM s WHERE sentence <> '')"""
_BEST_SENTENCE = """SELECT query_id, sentence FROM w WHERE len(own) > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(len(list_intersect(terms, list_distinct(own))) / len(own) + CASE WHEN regexp_matches(sentence, '[0-9]') THEN 0.15 ELSE 0 END, 9) DESC, octet_length(encode(sentence)), position, n) = 1"""


@query(f"WITH {_CONVERSED}, {_SENTENCES} {_BEST_SENTENCE}")
def lexical_sentence(spark, d):
    from tidemark.plans.catalog import _recalled

    return answers.best_sentences(*_recalled(spark, d))


@query(f"""WITH {_CONVERSED}, {_SENTENCES}, best AS ({_BEST_SENTENCE}), start AS (SELECT query_id, arg_min(text, position) AS first FROM c WHERE text <> '' GROUP BY query_id)
SELECT query_id, coalesce(CASE WHEN len({sql_terms('query')}) > 0 THEN sentence END, first) AS answer FROM asked JOIN start USING (query_id) LEFT JOIN best USING (query_id)""")
def answer_extract(spark, d):
    from tidemark.plans.catalog import _recalled

    items, asked = _recalled(spark, d)
    return answers.extract_answers(items, asked)


@query(f"""WITH {_CONVERSED}, n AS (SELECT query_id, position, text, len(regexp_extract_all(text, '[!-/:-@\\[-`{{-~]|[^\\s!-/:-@\\[-`{{-~]+')) AS cost FROM items WHERE position <= 10),
f AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY position) AS used FROM n), b AS (SELECT query_id, string_agg('[' || position || '] ' || text, chr(10) ORDER BY position) AS blocks FROM f WHERE used <= 4000 GROUP BY query_id),
p AS (SELECT query_id, 'Answer from the numbered context only and cite it by number.' || chr(10) || chr(10) || coalesce(blocks, '') || chr(10) || chr(10) || 'Question: ' || query AS prompt FROM asked LEFT JOIN b USING (query_id))
SELECT query_id, len(regexp_extract_all(prompt, '[!-/:-@\\[-`{{-~]|[^\\s!-/:-@\\[-`{{-~]+'))::BIGINT AS prompt_tokens, sha256(prompt) AS digest FROM p""")
def answer_prompts(spark, d):
    from tidemark.plans.catalog import _recalled

    return context.answer_prompt(*_recalled(spark, d)).select("query_id", F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"), F.sha2("prompt", 256).alias("digest"))


def _sql_named(name: str, source: str, text: str) -> str:
    """``name(query_id, position, terms, ents, years, low)`` of a table of texts."""
    inner = sql_entities(f"{name}_t", "key").replace("terms AS", f"{name}_w AS").replace("FROM terms", f"FROM {name}_w").replace("entities AS", f"{name}_e AS")
    return f"""{name}_t AS (SELECT query_id || '/' || position AS key, query_id, position, {text} AS text FROM {source}), {inner}, {name}_l AS (SELECT key, list(w) AS ents FROM {name}_e GROUP BY key),
{name} AS (SELECT query_id, position, text, {sql_terms('text')} AS terms, coalesce(ents, []) AS ents, {sql_years('text')} AS years, {lower('text')} AS low FROM {name}_t LEFT JOIN {name}_l USING (key))"""


def _when(cond: str, amount: str) -> str:
    return f"(CASE WHEN {cond} THEN {amount} ELSE 0 END)"


def _ratio(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / greatest(len({a}), 1)"


_LOW = lambda *w: sql_any("i.low", w)
_TENTATIVE = sql_any("i.low", t.TENTATIVE)
_COMPOSITE = " + ".join([
    "i.score", _when("len(q.terms) > 0 AND len(i.terms) > 0", f"0.55 * {_ratio('q.terms', 'i.terms')} + 0.25 * {_ratio('i.terms', 'q.terms')}"),
    _when("len(q.numeric) > 0", f"1.95 * {_ratio('q.numeric', 'i.ents')}"), _when("len(q.alpha) > 0", f"1.25 * {_ratio('q.alpha', 'i.alpha')}"), _when("len(q.ents) > 0", f"0.3 * {_ratio('q.ents', 'i.ents')}"),
    _when("len(q.ents) > 0 AND len(list_intersect(q.ents, i.ents)) = 0", f"-(CASE WHEN len(q.numeric) > 0 THEN 0.85 ELSE 0.45 END) - {_when('len(list_intersect(q.digits, i.terms)) > 0', '0.75')}"),
    _when("len(q.alpha) > 0 AND len(i.alpha) > 0 AND len(list_intersect(q.alpha, i.alpha)) = 0", "-0.4"), _when("len(q.years) > 0", f"1.25 * {_ratio('q.years', 'i.years')}"),
    _when("len(q.years) > 0 AND len(i.years) > 0 AND len(list_intersect(q.years, i.years)) = 0", "-1.1"),
    f"(CASE WHEN regexp_matches(i.text, '(moved|move) to [A-Z][a-z]+') THEN 1.6 WHEN {_LOW('moved to', 'move to')} THEN 0.45 WHEN {_LOW('city')} THEN 0.1 ELSE 0 END)",
    _when(_LOW("without a destination", "city move", "retrospective"), "-0.75"), _when(_LOW("allergic", "health", "peanut"), "-1.1"), _when(_LOW("prefer"), "-0.55"),
    f"(CASE WHEN {_LOW('public launch is')} AND NOT {_TENTATIVE} THEN 1.7 WHEN {_LOW('public launch')} THEN 1.2 ELSE 0 END)", _when(_TENTATIVE, "-greatest(2.45, i.score * 1.4)"),
    _when(_LOW("draft memo"), "-1.2"), _when(_LOW(" owns ", "owner", "deployment readiness"), "-0.4"),
    _when(sql_any("q.low", ("who", "owner", "owns", "deployment readiness")), f"{_when(_LOW(' owns ', 'owner', 'owns deployment readiness'), '1.1')} - {_when(_LOW('public launch') + ' AND NOT ' + _LOW(' owns '), '0.35')}"),
    _when(sql_any("i.low", t.DISTRACTORS), "-0.4"),
])
_ASKS_MORE = " where did person18 move and when is the launch of atlas10"


@query(f"""WITH {_CONVERSED}, {_sql_named('qs', '(SELECT query_id, 0 AS position, query FROM asked)', f"query || '{_ASKS_MORE}'")}, {_sql_named('xs', 'items', 'text')},
q AS (SELECT *, list_filter(ents, lambda w: regexp_matches(w, '[0-9]')) AS numeric, list_filter(ents, lambda w: regexp_full_match(w, '[A-Za-z]+')) AS alpha, list_filter(terms, lambda w: regexp_full_match(w, '[0-9]+')) AS digits FROM qs),
i AS (SELECT *, list_filter(ents, lambda w: regexp_full_match(w, '[A-Za-z]+')) AS alpha, 1 / (1 + position) AS score, row_number() OVER (PARTITION BY query_id ORDER BY position) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM xs),
c AS (SELECT i.query_id, i.position AS frame_id, i.score, place, CASE WHEN place <= 12 AND n > 1 THEN round(CASE WHEN i.text = '' THEN i.score ELSE {_COMPOSITE} END, 6)::DOUBLE END AS composite FROM i JOIN q USING (query_id))
SELECT query_id, frame_id, composite, CASE WHEN composite IS NULL THEN place ELSE row_number() OVER (PARTITION BY query_id, composite IS NULL ORDER BY composite DESC, score DESC, frame_id) END AS rank FROM c""")
def intent_rerank(spark, d):
    from tidemark.plans.catalog import _recalled

    items, asked = _recalled(spark, d)
    rows = items.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("position")).alias("rank"), F.col("position").alias("frame_id"), "score", F.col("text").alias("preview"), F.array(F.lit("text")).alias("sources"))
    places = asked.withColumn("query", F.concat("query", F.lit(_ASKS_MORE)))
    return rerank.intent_rerank(rows, places).select("query_id", F.col("rank").cast("bigint").alias("rank"), "frame_id", "composite")


_STEPS = r"[^\s{}\[\],:\"][\s{}\[\],:\"]"


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
j AS (SELECT l_orderkey AS doc_id, '{{"asset_name":"' || CASE l_orderkey % 3 WHEN 0 THEN 'GA_' WHEN 1 THEN 'W_' ELSE 'BP_' END || l_orderkey || '","asset_path":"/Game/Orders","graphs":[{{"name":"EventGraph","nodes":[' AS head,
  string_agg(',{{"node_guid":"' || n || '","class_path":"/Script/BlueprintGraph.K2Node_CallFunction","title":"call","function":{{"member_name":"Part' || l_partkey || '","member_parent":"/Script/Game.Supplier' || l_suppkey || '"}}}}', '' ORDER BY n) AS calls,
  string_agg('{{"from_node_guid":"' || n - 1 || '","from_pin_name":"then","to_node_guid":"' || n || '","to_pin_name":"execute"}}', ',' ORDER BY n) AS links,
  string_agg(',{{"title":"call","class":"K2Node_CallFunction","calls":"Part' || l_partkey || '","from":"Supplier' || l_suppkey || '"}}', '' ORDER BY n) AS short FROM l GROUP BY l_orderkey),
t AS (SELECT doc_id, head || '{{"node_guid":"0","class_path":"/Script/BlueprintGraph.K2Node_Event","title":"start","event_ref":{{"member_name":"Begin","member_parent":"/Script/Engine.Actor"}}}}' || calls || '],"links":[' || links || ']}}]}}' AS raw, head || '{{"title":"start","class":"K2Node_Event","event":"Begin"}}' || short || ']}}]}}' AS compressed FROM j)
SELECT doc_id, len(regexp_extract_all(raw, '{_STEPS}')) + 1 AS tokens_before, len(regexp_extract_all(compressed, '{_STEPS}')) + 1 AS tokens_after, sha256(compressed) AS digest FROM t""")
def graph_compress(spark, d):
    return graph.compress(T.graph_documents(spark, d)).select("doc_id", "tokens_before", "tokens_after", F.sha2("compressed", 256).alias("digest"))


@query("WITH c AS (SELECT item_id, item_id % 3 <> 0 AS cited, item_id % 3 = 1 AS whole FROM benchmark) SELECT count(*) AS queries, round(avg(cited::INT), 6) AS influence_rate, round(avg(whole::INT), 6) AS required_path_rate FROM c")
def citation_rates(spark, d):
    i = F.col("item_id")
    items = T.read(spark, d, "benchmark")
    pack = items.select(i.alias("query_id"), F.array(F.lit("src/"), i.cast("string")).alias("must_cite"))
    cited = items.filter(i % 3 != 0).select(i.alias("query_id"), F.when(i % 3 == 1, F.concat(F.lit("src/"), i.cast("string"))).otherwise(F.lit("docs/x")).alias("path"))
    rates = evaluate.citation_rates(pack, cited)
    return rates.select("queries", F.round("influence_rate", 6).alias("influence_rate"), F.round("required_path_rate", 6).alias("required_path_rate"))


# ---- ingest


def sql_fnv(c: str) -> str:
    return f"lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(generate_series(1, octet_length(encode({c}))), lambda i: ('0x' || hex(encode({c})[i:i]))::INT::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0')"


@query(f"""WITH f AS (SELECT doc_id, 1 + doc_id % 5 AS w, 10 + doc_id % 50 AS n, 20 // (1 + doc_id % 5) AS l, 20 // (1 + doc_id % 5) - 5 // (1 + doc_id % 5) AS stride FROM documents),
c AS (SELECT *, unnest(generate_series(0, CASE WHEN n > l THEN ceil((n - l) / stride)::BIGINT ELSE 0 END)) AS k FROM f), r AS (SELECT doc_id, w, k * stride + 1 AS first, least(k * stride + l, n) AS last FROM c),
b AS (SELECT 'd/' || doc_id || '.py' AS relative_path, first, last, w, array_to_string(list_transform(generate_series(first, last), lambda i: repeat('x' || i || ' ', w)), chr(10)) AS body FROM r)
SELECT relative_path, 'python' AS language, '' AS symbol, first::INT AS line_start, last::INT AS line_end, (w * (last - first + 1))::INT AS token_estimate, octet_length(encode(body))::BIGINT AS size_bytes, {sql_fnv('body')} AS content_hash FROM b""")
def line_windows(spark, d):
    i = F.col("doc_id")
    lines = F.transform(F.sequence(F.lit(1).cast("bigint"), 10 + i % 50), lambda k: F.repeat(F.concat(F.lit("x"), k.cast("string"), F.lit(" ")), (i % 5 + 1).cast("int")))
    files = T.read(spark, d, "documents").select(_glue("d/", "@doc_id", ".py").alias("relative_path"), F.array_join(lines, "\n").alias("text"))
    return chunks.chunk_lines(files, 20, 5).drop("text", "chunk_id")


_BODIES = ["// class Not\nclass Foo{0} : public Bar {{\n}};\n", "struct S{0} {{ int a; }};\n", "if (a) {{\n  return b();\n}}\nvoid Run{0}(int a) {{\n}}\n", "int x = {0};\n", "namespace N{0} {{\n}}\n"]


SYMBOLS = (f"""WITH f AS (SELECT doc_id, 's/' || doc_id || '.cpp' AS relative_path, CASE doc_id % 5 """ + " ".join(f"WHEN {n} THEN replace({quoted([b.replace('{{', '{').replace('}}', '}').replace('{0}', '@')])}, '@', doc_id::VARCHAR)" for n, b in enumerate(_BODIES)) + f""" END AS text,
  CASE doc_id % 5 WHEN 0 THEN 'Foo' || doc_id WHEN 1 THEN 'S' || doc_id WHEN 2 THEN 'Run' || doc_id WHEN 4 THEN 'N' || doc_id ELSE '' END AS symbol FROM documents),
g AS (SELECT *, rtrim(text, chr(10)) AS body, len(string_split(rtrim(text, chr(10)), chr(10))) AS n FROM f), h AS (SELECT *, {sql_fnv('body')} AS hash FROM g),
k AS (SELECT *, relative_path || chr(10) || symbol || chr(10) || '1:' || n || chr(10) || hash AS id FROM h) SELECT relative_path, symbol, {sql_fnv('id')} AS chunk_id FROM k""")


def symbol_files(spark, d) -> DataFrame:
    """``(relative_path, text)``: small source files, with a symbol or without."""
    made = F.element_at(F.array(*[_glue(*[x for part in b.replace("{{", "{").replace("}}", "}").split("{0}") for x in (part, "@doc_id")][:-1]) for b in _BODIES]), (F.col("doc_id") % 5 + 1).cast("int"))
    return T.read(spark, d, "documents").select(_glue("s/", "@doc_id", ".cpp").alias("relative_path"), made.alias("text"))


@query(SYMBOLS)
def symbols(spark, d):
    return chunks.chunk_lines(symbol_files(spark, d), 400, 40).select("relative_path", "symbol", "chunk_id")


@query("SELECT count(*) AS batches, sum(event_id % 7)::BIGINT AS files, sum(event_id % 3)::BIGINT AS unchanged, sum(event_id % 11)::BIGINT AS chunks, sum(event_id % 2)::BIGINT AS facts, round(sum(value), 3) AS seconds, round(sum(event_id % 11) / sum(value), 6) AS chunks_per_second FROM events")
def index_throughput(spark, d):
    i = F.col("event_id")
    rows = T.read(spark, d, "events").select(i.alias("batch"), *[(i % n).alias(c) for c, n in (("files", 7), ("unchanged", 3), ("chunks", 11), ("facts", 2))], F.col("value").alias("seconds"))
    return streams.throughput(rows).withColumn("seconds", F.round("seconds", 3))


@query("SELECT 'f' || event_id % 50 || '.cpp' AS relative_path, max(event_id // 50)::BIGINT AS batch FROM events GROUP BY 1")
def latest_files(spark, d):
    i = F.col("event_id")
    return streams._latest(T.read(spark, d, "events").select(_glue("f", (i % 50).cast("string"), ".cpp").alias("relative_path"), F.expr("event_id div 50").alias("batch")))


# ---- store


@query(f"WITH {FRAMES} SELECT frame_id, ts_ms, sha256(text) AS digest FROM frames WHERE frame_id % 7 = 3")
def frame_lookup(spark, d):
    ids = T.read(spark, d, "documents").select(F.explode(F.array("doc_id", -F.col("doc_id") - 1, "doc_id")).alias("frame_id")).filter("frame_id % 7 = 3")
    return store.lookup(T.frames(spark, d), ids).select("frame_id", "ts_ms", F.sha2("text", 256).alias("digest"))


@query("SELECT 2 * event_id AS seq, 'put' AS kind, event_id AS frame_id FROM events WHERE 2 * event_id > 777 UNION ALL SELECT 2 * event_id + 1, 'delete', event_id // 2 FROM events WHERE event_id % 7 = 3 AND 2 * event_id + 1 > 777 UNION ALL SELECT 2 * event_id + 1, 'supersede', event_id - 5 FROM events WHERE event_id % 11 = 5 AND event_id % 7 <> 3 AND 2 * event_id + 1 > 777")
def pending_mutations(spark, d):
    log = T.mutations(spark, d)
    return store.pending(log.union(log.filter("seq % 10 = 0")), 777).select("seq", "kind", "frame_id")


@query("WITH n AS (SELECT count(*) AS n FROM documents) SELECT doc_id AS frame_id, CASE WHEN doc_id % 13 = 0 OR doc_id % 10 = 4 THEN 1 ELSE 0 END AS status, CASE WHEN doc_id % 17 = 0 AND doc_id + 1 < n THEN doc_id + 1 END AS superseded_by FROM documents, n UNION ALL SELECT doc_id + n, 0, NULL FROM documents, n WHERE doc_id < 50")
def pending_overlay(spark, d):
    frames, n = T.frames(spark, d), F.lit(None).cast("bigint")
    total = frames.count()
    frames = frames.withColumn("superseded_by", F.when(F.col("superseded_by") < total, F.col("superseded_by")))
    i = F.col("frame_id")
    seen = frames.filter(i % 10 == 4).select((i + 1000).alias("seq"), F.lit("delete").alias("kind"), "frame_id", n.alias("other_id"), "ts_ms", F.lit(None).cast("string").alias("text"))
    new = frames.filter(i < 50).select((i + 500).alias("seq"), F.lit("put").alias("kind"), (i + total).alias("frame_id"), n.alias("other_id"), "ts_ms", "text")
    old = frames.filter(i % 3 == 0).select((i - total - 5).alias("seq"), F.lit("delete").alias("kind"), "frame_id", n.alias("other_id"), "ts_ms", F.lit(None).cast("string").alias("text"))
    return store.overlay(frames, new.unionByName(seen).unionByName(old), 100).select("frame_id", "status", "superseded_by")


@query("""WITH l AS (SELECT event_id AS old, event_id + 3 AS new FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT 1000000 + event_id % 10, 1000000 + (event_id + 1) % 10 FROM events WHERE event_id < 10 UNION ALL SELECT 2000000 + event_id, 1000003 FROM events WHERE event_id < 5)
SELECT event_id + 1000000 AS node, 1000000 AS cycle FROM events WHERE event_id < 10 UNION ALL SELECT 2000000 + event_id, 1000000 FROM events WHERE event_id < 5""")
def supersede_cycles(spark, d):
    """Chains of events beside a planted cycle and frames before it.

    Unlike in the SQL's ``l``, which its answer does not read, events have negative ids: from a million events on they would
    be planted frames too, and those before the cycle would belong to the answer, against the SQL.
    """
    e, i = T.read(spark, d, "events"), F.col("event_id")
    link = lambda rows, old, new: rows.select(old.alias("old"), new.alias("new"))
    links = link(e.filter(i % 4 != 0), -i - 1, -i - 4).union(link(e.filter(i < 10), 1_000_000 + i % 10, 1_000_000 + (i + 1) % 10)).union(link(e.filter(i < 5), 2_000_000 + i, F.lit(1_000_003).cast("bigint")))
    return store.supersede_cycles(links)


@query("WITH RECURSIVE l AS (SELECT event_id AS old, event_id + 3 AS new FROM events WHERE event_id % 4 <> 0), walk AS (SELECT old AS root, new AS tip FROM l WHERE old NOT IN (SELECT new FROM l) UNION ALL SELECT root, l.new FROM walk JOIN l ON l.old = walk.tip) SELECT tip, min(root) AS root FROM walk WHERE tip NOT IN (SELECT old FROM l) GROUP BY tip")
def surrogate_map(spark, d):
    e = T.read(spark, d, "events").filter("event_id % 4 <> 0")
    return store.surrogate_map(e.select(F.col("event_id").alias("old"), (F.col("event_id") + 3).alias("new")))


@query("""WITH p AS (SELECT event_id AS k FROM events) SELECT 10 * k + 1 AS seq, 'unknown frame' AS error FROM p WHERE k % 6 = 0 UNION ALL SELECT 10 * k + 2, 'supersedes itself' FROM p WHERE k % 6 = 1
UNION ALL SELECT 10 * k + 7, 'conflicting link' FROM p WHERE k % 6 = 4 AND k >= 4 UNION ALL SELECT 10 * k + 8, 'cycle' FROM p WHERE k % 6 = 5""")
def mutation_faults(spark, d):
    """A log with a deletion before its put, links to itself, second successors and cycles of three."""
    e, i = T.read(spark, d, "events"), F.col("event_id")
    row = lambda rows, seq, kind, frame, other=None: rows.select(seq.alias("seq"), F.lit(kind).alias("kind"), frame.alias("frame_id"), (F.lit(None).cast("bigint") if other is None else other).alias("other_id"), F.lit(0).cast("bigint").alias("ts_ms"), F.lit("x").alias("text"))
    log = row(e, i * 10, "put", i)
    log = log.union(row(e.filter(i % 6 == 0), i * 10 + 1, "delete", i + 1_000_000_000)).union(row(e.filter(i % 6 == 1), i * 10 + 2, "supersede", i, i))
    log = log.union(row(e.filter(i % 6 == 4), i * 10 + 6, "supersede", i - 1, i)).union(row(e.filter(i % 6 == 4), i * 10 + 7, "supersede", i - 1, i - 2))
    a = e.filter(i % 6 == 5)
    return store.mutation_errors(log.union(row(a, i * 10 + 6, "supersede", i, i - 5)).union(row(a, i * 10 + 7, "supersede", i - 5, i - 4)).union(row(a, i * 10 + 8, "supersede", i - 4, i)))


@query("SELECT doc_id AS frame_id, text FROM documents WHERE doc_id % 9 = 2 AND source = 'src1' AND doc_id % 13 <> 0 ORDER BY doc_id DESC LIMIT 1")
def latest_handoff(spark, d):
    rows = T.read(spark, d, "documents").select(F.col("doc_id").alias("frame_id"), "text", F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0).alias("status"), F.lit(None).cast("bigint").alias("superseded_by"), F.when(F.col("doc_id") % 9 == 2, "handoff").alias("kind"), F.create_map(F.lit("project"), "source").alias("metadata"))
    return store.latest_handoff(rows, "src1").select("frame_id", "text")


@query(f"WITH {EAV} SELECT entity, attribute, id FROM eav WHERE starts_with(entity, 'supplier:') ORDER BY entity, attribute, id LIMIT 32")
def fact_search_limit(spark, d):
    return facts.by_prefix(T.eav(spark, d), "supplier:").select("entity", "attribute", "id")


@query("""WITH s AS (SELECT event_id % 997 AS frame_id, count(*) AS accesses, min(floor(epoch(ts))::BIGINT * 1000) AS first_ms, max(floor(epoch(ts))::BIGINT * 1000) AS last_ms FROM events GROUP BY 1)
SELECT frame_id, (accesses * CASE WHEN frame_id % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS accesses, first_ms, CASE WHEN frame_id % 2 = 0 THEN last_ms + 5 ELSE last_ms END AS last_ms FROM s WHERE frame_id % 3 <> 0""")
def access_merge(spark, d):
    own = maintain.access_stats(T.access_log(spark, d))
    other = own.filter("frame_id % 2 = 0").withColumn("last_ms", F.col("last_ms") + 5)
    return maintain.prune_access(maintain.merge_access(own, other), own.filter("frame_id % 3 <> 0"))


# ---- vectors and models


def _length_model(texts: list[str]) -> list[list[float]]:
    return [[float(len(x)), 1.0] for x in texts]


@query("SELECT doc_id AS frame_id, round(length(text) / sqrt(length(text)::DOUBLE * length(text) + 1), 6) AS first, round(1 / sqrt(length(text)::DOUBLE * length(text) + 1), 6) AS second FROM documents")
def remote_embedding(spark, d):
    made = vector_search.embed_texts(T.frames(spark, d).select("frame_id", "text"), _length_model)
    return made.select("frame_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.round(F.get("embedding", F.lit(1)), 6).alias("second"))


@query("SELECT doc_id AS frame_id, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 3 = 0) THEN -1.0 ELSE round(1 / sqrt(length(text)::DOUBLE * length(text) + 1), 6) END::DOUBLE AS second FROM documents")
def embedding_memo(spark, d):
    rows = T.frames(spark, d).select("frame_id", "text")
    memo = rows.filter("frame_id % 3 = 0").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"), F.array(F.lit(0.0), F.lit(-1.0)).alias("embedding")).distinct()
    return vector_search.embed_with_memo(rows, memo, _length_model)[0].select("frame_id", F.round(F.get("embedding", F.lit(1)), 6).alias("second"))


@query("SELECT vec_id AS frame_id, vec_id % 5 IN (0, 3) AS reused FROM embeddings WHERE vec_id % 5 <> 4 UNION ALL SELECT vec_id, false FROM embeddings WHERE vec_id % 5 = 4")
def reuse_vectors(spark, d):
    v, i = T.vectors(spark, d), F.col("frame_id")
    stored = v.filter(i % 5 != 4).select("frame_id", F.when(i % 5 == 1, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("embedding"), F.when(i % 5 == 2, "other").when(i % 5 == 0, "").otherwise("mine").alias("identity"))
    keep, todo = vector_search.reuse_or_embed(v.select("frame_id"), stored, 64, "mine")
    return keep.select("frame_id", F.lit(True).alias("reused")).union(todo.select("frame_id", F.lit(False)))


@query(f"""WITH tk AS (SELECT doc_id AS frame_id, {lower("unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))")} AS w FROM documents), h AS (SELECT w, {sql_fnv('w')} AS x FROM (SELECT DISTINCT w FROM tk)),
n AS (SELECT w, ('0x' || x)::UBIGINT AS u FROM h), s AS (SELECT frame_id, (u % 384)::BIGINT AS place, sum(CASE WHEN u >= 9223372036854775808 THEN -1 ELSE 1 END) AS v FROM tk JOIN n USING (w) GROUP BY ALL),
m AS (SELECT frame_id, sqrt(sum(v * v)) AS m FROM s GROUP BY frame_id) SELECT frame_id, place, round(v / m, 6)::DOUBLE AS value FROM s JOIN m USING (frame_id) WHERE v <> 0""")
def hash_embedding(spark, d):
    rows = vector_search.hash_embedding(T.frames(spark, d).select("frame_id", "text")).select("frame_id", F.posexplode("embedding").alias("place", "value"))
    return rows.filter("value <> 0").select("frame_id", F.col("place").cast("bigint").alias("place"), F.round("value", 6).alias("value"))


def _told(prompt: str) -> str:
    """A stand-in for a model: some thoughts, then facts as JSON, some of which are none."""
    name = prompt.rsplit("\n", 1)[-1]
    return f'<think>[1, 2]</think>Here: [{{"entity": "{name}", "attribute": "kind", "value": "doc"}}, {{"entity": "file:{name}", "attribute": "calls", "value": "then"}}, {{"entity": "bp:{name}", "attribute": "id", "value": "0123456789abcdef"}}, {{"entity": "", "attribute": "a", "value": "b"}}, {{"entity": "file:{name}", "attribute": "lang", "value": "x"}}] and more'


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'bp:n' ELSE 'cpp:n' END || doc_id AS entity, 'kind' AS attribute, 'doc' AS value FROM documents UNION ALL SELECT 'file:n' || doc_id, 'lang', 'x' FROM documents")
def model_facts(spark, d):
    i = F.col("doc_id")
    rows = T.read(spark, d, "documents").select(i.cast("string").alias("chunk_id"), F.concat(_glue("a/", "@doc_id"), F.when(i % 2 == 0, ".bpl_json").otherwise(".cpp")).alias("relative_path"), F.lit("").alias("symbol"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), _glue("n", "@doc_id").alias("text"))
    return enrich.model_facts(rows, _told).select("entity", "attribute", "value")


_PURPOSES = ["```The blueprint handles doors.```", "<think>hm</think> \"Opens doors.\"", "This asset is a lamp..", "plain   words"]
_CLEANED = ["doors", "Opens doors", "lamp", "plain words"]


@query(f"SELECT doc_id, {_sql_pick('doc_id', _CLEANED)} AS purpose FROM documents")
def purpose_clean(spark, d):
    return T.read(spark, d, "documents").select("doc_id", enrich.clean_purpose(_pick("doc_id", _PURPOSES)).alias("purpose"))


@query("SELECT 'bp:' || doc_id AS entity, CASE WHEN doc_id % 4 = 0 THEN 'cached' ELSE length('Make ' || source) || ' letters' END AS purpose FROM documents")
def purpose_cache(spark, d):
    rows = T.read(spark, d, "documents").select(_glue("bp:", "@doc_id").alias("entity"), F.sha2("text", 256).alias("structural_hash"), _glue("Make ", "@source").alias("prompt"), "doc_id")
    cache = rows.filter("doc_id % 2 = 0").select("entity", F.when(F.col("doc_id") % 4 == 0, F.col("structural_hash")).otherwise("old").alias("structural_hash"), F.lit("cached").alias("purpose"))
    return enrich.generate_purposes(rows, cache, lambda x: f"`{len(x)} letters.`").select("entity", "purpose")


@query("SELECT doc_id, 'B' || doc_id || '/C' AS folder, 'Game_B' || doc_id || '_C_D_D.bpl_json' AS file FROM documents")
def export_paths(spark, d):
    path = _glue("/Game/B", "@doc_id", "/C/D.D")
    return T.read(spark, d, "documents").select("doc_id", enrich.folder_hint(path).alias("folder"), enrich.export_name(path).alias("file"))


@query("SELECT 'bp:D' || doc_id AS entity, CASE WHEN doc_id % 3 = 0 THEN 'x/A_D' || doc_id || '_D' || doc_id || '.bpl_json' WHEN doc_id % 3 = 1 THEN 'x/B_D' || doc_id || '.bpl_json' END AS file FROM documents WHERE doc_id % 3 <> 2")
def export_files(spark, d):
    docs, i = T.read(spark, d, "documents"), F.col("doc_id")
    name = _glue("D", "@doc_id")
    one = docs.filter(i % 3 == 0).select(F.explode(F.array(F.concat(F.lit("x/A_"), name, F.lit("_"), name, F.lit(".bpl_json")), F.concat(F.lit("x/LongerA_"), name, F.lit("_"), name, F.lit(".bpl_json")), F.concat(F.lit("x/"), name, F.lit(".bpl_json")))).alias("file"))
    two = docs.filter(i % 3 == 1).select(F.concat(F.lit("x/B_"), name, F.lit(".bpl_json")).alias("file"))
    return enrich.find_export(docs.select(F.concat(F.lit("bp:"), name).alias("entity")), one.union(two))


@query("SELECT 'bp:' || doc_id AS entity, source || '. widget' || CASE WHEN doc_id % 2 = 0 THEN '. shows ' || lang ELSE '' END || '. on Begin: A → B. calls A, B. events Begin' || CASE WHEN doc_id % 3 = 0 THEN '. casts to C' ELSE '' END AS text FROM documents")
def embedding_lines(spark, d):
    i = F.col("doc_id")
    none = F.array().cast("array<string>")
    rows = T.read(spark, d, "documents").select(_glue("bp:", "@doc_id").alias("entity"), F.col("source").alias("asset_name"), F.lit("widget").alias("kind"), F.when(i % 2 == 0, _glue("shows ", "@lang")).otherwise("").alias("purpose"), F.array(F.struct(F.lit("Begin").alias("event"), F.lit("A → B").alias("chain"))).alias("exec_chains"), F.array(F.lit("A"), F.lit("B")).alias("calls"), F.array(F.lit("Begin")).alias("events"), F.when(i % 3 == 0, F.array(F.lit("C"))).otherwise(none).alias("casts_to"))
    return enrich.embedding_text(rows)


@query(f"""WITH {EAV}, r AS (SELECT entity, attribute, value FROM eav WHERE starts_with(entity, 'nation:') OR starts_with(entity, 'customer:') UNION ALL SELECT 'frame:' || doc_id, 'text', CASE WHEN doc_id % 5 = 0 THEN 'Some AUTOMOBILE notes' ELSE 'none' END FROM documents)
SELECT DISTINCT entity, attribute, value FROM r WHERE regexp_matches(lower(entity || ' ' || attribute || ' ' || value), 'automobile|n_name')""")
def stitch_facts(spark, d):
    recalled = T.read(spark, d, "documents").select(F.col("doc_id").alias("frame_id"), F.when(F.col("doc_id") % 5 == 0, "Some AUTOMOBILE notes").otherwise("none").alias("text"))
    eav = T.eav(spark, d)
    return enrich.stitch(eav.union(eav.filter("id % 2 = 0")), recalled.union(recalled.filter("frame_id % 10 = 0")), ["nation:", "customer:"], ["automobile", "n_name"])
