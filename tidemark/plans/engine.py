"""One object for what the engine does: searching, recalling, remembering, facts, ingest and graph documents.

Every call takes and returns DataFrames and searches a whole table of queries at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.vectors import is_finite
from tidemark.operators import answers, chunks, context, enrich, facts, fulltext, fusion, graph, maintain, rerank, store, vector_search
from tidemark.streaming import streams


FRAMES = "frame_id long, ts_ms long, text string, sha256 string, status int, kind string, metadata map<string,string>, labels array<string>, supersedes long, superseded_by long"
EMBEDDINGS = "seq long, frame_id long, embedding array<double>, identity string"
FACT_LOG = "seq long, op string, entity string, attribute string, value string, metadata map<string,string>, id long, supersedes long, ts_ms long"


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, internal: tuple[str, ...] = ()):
        self.spark = spark
        self.store = store.FrameStore(spark, root) if root else None
        self.internal = internal  # what payloads that are no user's text begin with
        self.waiting: list[tuple] = []  # facts that are staged, not committed

    # ---- searching

    def lanes(self, frames: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, facts_table: DataFrame | None = None, k: int = 10) -> DataFrame:
        """Text hits of frames and facts, and vector hits, as one lane table; fact ids lie below zero."""
        previews = frames.select("frame_id", F.col("text").alias("preview"))
        alive = frames.filter("status = 0")
        text = fulltext.bm25_search(alive, queries, k).join(previews, "frame_id").select("query_id", F.lit("text").alias("lane"), "frame_id", "score", "preview")
        if facts_table is not None:
            own = facts_table.select((-1 - F.col("id")).alias("frame_id"), facts.preview().alias("text"))
            hits = fulltext.bm25_search(own, queries, k).join(own, "frame_id").select("query_id", F.lit("text").alias("lane"), "frame_id", "score", F.col("text").alias("preview"))
            text = text.unionByName(hits)
        if vectors is None or query_vectors is None:
            return text
        found = vector_search.knn_exact(vectors, query_vectors, "cosine", k).join(previews, "frame_id", "left")
        return text.unionByName(found.select("query_id", F.lit("vector").alias("lane"), "frame_id", "score", "preview"))

    def search(self, frames: DataFrame, queries: DataFrame, mode: str = "text", alpha: float = 0.5, k: int = 10, adaptive: bool = True, min_score: float | None = None, window: int = 12, **lanes: DataFrame) -> DataFrame:
        """``(query_id, rank, frame_id, score, preview, sources)``, reranked by intent; ``mode`` is text, vector or hybrid."""
        rows = self.lanes(frames, queries, k=k, **lanes)
        if mode != "hybrid":
            merged = fusion.merge_duplicates(rows.filter(F.col("lane") == mode))
            hits = fusion.top_k(merged, ["query_id"], [F.desc("score"), F.asc("frame_id")], k)
        else:
            hits = fusion.weighted_rrf(rows, fusion.adaptive_weights(queries).drop("class") if adaptive else None, alpha, k=k)
        if min_score is not None:
            hits = hits.filter(F.col("score") >= min_score)
        return rerank.intent_rerank(hits.select("query_id", "rank", "frame_id", "score", "preview", "sources"), queries, window).drop("composite")

    def recall(self, frames: DataFrame, queries: DataFrame, k: int = 24, filters: dict | None = None, tiers: tuple[DataFrame, DataFrame] | None = None, **search) -> tuple[DataFrame, DataFrame]:
        """The contexts and the answers of all queries; ``tiers`` puts summaries in place of texts."""
        hits = self.search(frames, queries, k=k, **search)
        if filters is not None:
            hits = fusion.filter_frames(hits, frames, **filters)
        if tiers is not None:
            hits = hits.join(maintain.tiered_text(*tiers), "frame_id", "left").withColumn("preview", F.coalesce("text", "preview")).drop("text")
        items = context.build_context(hits.select("query_id", "frame_id", "score", "preview"), k)
        return items, answers.extract_answers(items, queries)

    def answer_prompts(self, items: DataFrame, frames: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        return context.answer_prompt(items, queries), context.citations(items, frames)

    # ---- remembering

    def remember(self, new: DataFrame, target: int = 400, overlap: int = 40, session: str | None = None) -> int:
        """Chunks ``new(ord, ts_ms, text, metadata)``, appends the chunks as frames and commits a generation."""
        rows = new
        if session:
            rows = rows.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, v: k != "session"), F.create_map(F.lit("session"), F.lit(session))))
        cut = chunks.chunk_words(rows.withColumnRenamed("ord", "frame_id"), target, overlap)
        pieces = cut.join(rows.select(F.col("ord").alias("frame_id"), "ts_ms", "metadata"), "frame_id").select(F.struct("frame_id", "chunk").alias("ord"), "ts_ms", "text", "metadata")
        last = self.store.current()
        return self.store.commit(append={"frames": store.new_frames(self.store.read_or_empty("frames", FRAMES), pieces)}, expect=last)

    def remember_handoff(self, content: str, ts_ms: int, project: str | None = None, pending: list[str] | None = None) -> int:
        meta = {"kind": "handoff", **({"project": project} if project else {}), **({"pending": "\n".join(pending)} if pending else {})}
        return self.remember(self.spark.createDataFrame([(0, ts_ms, content, meta)], "ord long, ts_ms long, text string, metadata map<string,string>"), target=1 << 30, overlap=0)

    def latest_handoff(self, project: str | None = None) -> DataFrame:
        return store.latest_handoff(self.store.read("frames"), project)

    def frames(self, ids: list[int] | DataFrame | None = None, payload: bool = True) -> DataFrame:
        """All frames, or those of ids (a list or a table with ``frame_id``), with or without their texts."""
        rows = self.store.read_or_empty("frames", FRAMES)
        if ids is None:
            return rows if payload else rows.drop("text")
        return store.lookup(rows, self.spark.createDataFrame([(i,) for i in ids], "frame_id long") if isinstance(ids, list) else ids, payload)

    def contents(self, ids: list[int] | DataFrame) -> DataFrame:
        """``(frame_id, text)`` of frames, none of them an internal payload."""
        return self.frames(ids).filter(~store.is_internal(F.col("text"), self.internal)).select("frame_id", "text")

    def put_embeddings(self, rows: DataFrame, identity: str = "") -> int:
        """Appends vectors ``(frame_id, embedding)`` of known frames; they must be finite and of the length held so far."""
        bad = rows.join(self.frames(payload=False).select("frame_id"), "frame_id", "left_anti").select("frame_id").first()
        if bad:
            raise ValueError(f"no frame {bad['frame_id']}")
        held = self.store.read_or_empty("embeddings", EMBEDDINGS)
        dim = held.select(F.size("embedding").alias("n")).first() or rows.select(F.size("embedding").alias("n")).first()
        if dim and rows.filter((F.size("embedding") != dim["n"]) | (F.size("embedding") < 1) | ~is_finite(F.col("embedding"))).take(1):
            raise ValueError(f"a vector is not finite or not of {dim['n']} dimensions")
        start = held.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
        made = rows.select(F.lit(start).cast("bigint").alias("seq"), F.col("frame_id").cast("bigint").alias("frame_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(identity).alias("identity"))
        return self.store.commit(append={"embeddings": made})

    def vectors(self) -> DataFrame:
        """``(frame_id, embedding)``: the last vector of each live frame."""
        rows = vector_search.latest_valid(self.store.read_or_empty("embeddings", EMBEDDINGS))
        return rows.join(store.live(self.frames(payload=False)).select("frame_id"), "frame_id", "left_semi")

    def rebuild(self) -> dict[str, DataFrame]:
        """What is derived from the stored logs, made anew: facts, live frames, vectors, and what superseded what."""
        frames = self.frames()
        links = frames.filter("superseded_by is not null").select(F.col("frame_id").alias("old"), F.col("superseded_by").alias("new"))
        return {"facts": self.facts(), "live": store.live(frames), "vectors": self.vectors(), "surrogate_map": store.surrogate_map(links)}

    def optimize_surrogates(self, overwrite: bool = False) -> int:
        """Summarizes the frames that have no summaries yet."""
        made = self.store.read_or_empty("surrogates", "frame_id long, full string, gist string, micro string")
        todo = maintain.summary_candidates(self.store.read("frames"), made, overwrite)
        fresh = maintain.summarize(todo.select("frame_id", "text"))
        kept = made.join(todo.select("frame_id"), "frame_id", "left_anti")
        return self.store.commit({"surrogates": kept.unionByName(fresh)})

    def start_index(self, files: DataFrame, enricher=None, checkpoint: str | None = None, interval: str | None = None):
        """Starts the ingest of a stream of ``(relative_path, text)``; the query that comes back tells its progress and stops it."""
        return streams.ingest_stream(files, self.store, enricher, checkpoint, interval)

    def index_status(self) -> DataFrame:
        """One row: what the index jobs have done so far, and how fast."""
        return streams.throughput(self.store.read_or_empty("index_status", streams.STATUS))

    def report(self) -> DataFrame:
        return self.store.report()

    # ---- facts

    def _fact_log(self, staged: bool = False) -> DataFrame:
        log = self.store.read_or_empty("fact_log", FACT_LOG)
        return log.unionByName(self.spark.createDataFrame(self.waiting, FACT_LOG)) if staged and self.waiting else log

    def _pins(self) -> DataFrame:
        return self.store.read_or_empty("pins", "entity string, attribute string")

    def facts(self, as_of_ms: int | None = None, staged: bool = False) -> DataFrame:
        """The current facts, or those of a time; with ``staged`` as they will be after the next commit."""
        pins = self._pins().distinct().withColumn("pinned", F.lit(True))
        return facts.latest(self._fact_log(staged), as_of_ms).join(pins, ["entity", "attribute"], "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))

    def search_facts(self, prefix: str = "", limit: int = 100) -> DataFrame:
        return facts.by_prefix(self.facts(), prefix, limit)

    def _append(self, op: str, entity: str, attribute: str, value: str | None, metadata: dict[str, str], ts_ms: int, supersedes: int | None = None, commit: bool = True) -> int:
        seq = self.waiting[-1][0] + 1 if self.waiting else self._fact_log().agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
        self.waiting.append((seq, op, entity, attribute, value, metadata, seq, supersedes, ts_ms))
        if commit:
            self.flush()
        return seq

    def flush(self) -> int | None:
        """Commits the staged facts, as one part behind the log; None if there are none.  If another writer has committed since they stay staged."""
        if not self.waiting:
            return None
        number = self.store.commit(append={"fact_log": self.spark.createDataFrame(self.waiting, FACT_LOG).coalesce(1)})
        self.waiting.clear()
        return number

    def rollback(self) -> None:
        """Forgets the staged facts."""
        self.waiting.clear()

    def add_fact(self, entity: str, attribute: str, value: str, metadata: dict[str, str] | None = None, ts_ms: int = 0, commit: bool = True) -> int:
        """Adds or replaces a fact and returns the revision's id; without ``commit`` it is only staged."""
        if not entity or not attribute:
            raise ValueError("a fact has an entity and an attribute")
        return self._append("upsert", entity, attribute, value, metadata or {}, ts_ms, commit=commit)

    def get_fact(self, id_: int) -> DataFrame:
        """A revision of a fact, current or not."""
        return facts.versions(self._fact_log()).filter(F.col("id") == id_)

    def _current(self, id_: int):
        row = self.facts().filter(F.col("id") == id_).first()
        if row is not None and row["pinned"]:
            raise ValueError("a pinned fact cannot be changed")
        return row

    def update_fact(self, id_: int, value: str, metadata: dict[str, str] | None = None, ts_ms: int = 0) -> int:
        """A new revision of a current fact that is not pinned; its metadata are merged, the new ones winning."""
        row = self._current(id_)
        if row is None:
            raise ValueError("only the current revision of a fact can be updated")
        return self._append("upsert", row["entity"], row["attribute"], value, {**(row["metadata"] or {}), **(metadata or {})}, ts_ms, id_)

    def delete_fact(self, id_: int, ts_ms: int = 0) -> bool:
        row = self._current(id_)
        if row is None:
            return False
        self._append("remove", row["entity"], row["attribute"], None, {}, ts_ms)
        return True

    def pin_fact(self, id_: int, pinned: bool = True) -> int:
        row = self.facts().filter(F.col("id") == id_).select("entity", "attribute", "pinned")
        if not (found := row.first()):
            raise ValueError("only current facts can be pinned")
        if found["pinned"] != pinned:
            key = row.select("entity", "attribute")
            self.store.commit({"pins": self._pins().unionByName(key) if pinned else self._pins().join(key, ["entity", "attribute"], "left_anti")})
        return id_

    def forget(self, entity: str, attribute: str, ts_ms: int = 0) -> bool:
        """Deletes the current fact of a key."""
        row = self.facts().filter((F.col("entity") == entity) & (F.col("attribute") == attribute)).first()
        return bool(row) and self.delete_fact(row["id"], ts_ms)

    def fact_history(self, id_: int) -> DataFrame:
        return facts.history(facts.versions(self._fact_log()), id_)

    # ---- graph documents

    def read_graph(self, documents: DataFrame, name: str, compressed: bool = False) -> DataFrame:
        """``documents(doc_id, json)`` of this asset, in full or compressed."""
        own = documents.filter(F.get_json_object(F.regexp_replace("json", "^\ufeff", ""), "$.asset_name") == name)
        return graph.compress(own) if compressed else own

    def write_graphs(self, documents: DataFrame) -> int:
        """Commits documents that name their blueprint; the generation before is the backup."""
        bad = documents.filter(F.get_json_object(F.regexp_replace("json", "^\ufeff", ""), "$.blueprint").isNull())
        if bad.take(1):
            raise ValueError("a document has no blueprint key")
        kept = self.store.read_or_empty("graphs", "doc_id long, json string")
        return self.store.commit({"graphs": chunks.upsert(kept, documents.select("doc_id", "json"), "doc_id")})

    def patch_graphs(self, documents: DataFrame, intents: DataFrame) -> DataFrame:
        return graph.patch(documents, intents)

    def graph_facts(self, raw: DataFrame) -> DataFrame:
        return graph.structural_facts(raw)

    def refresh_graphs(self, raw: DataFrame, stored: DataFrame, purposes: DataFrame) -> DataFrame:
        """Fresh facts with purpose and status against the stored ones."""
        return chunks.refresh_status(enrich.with_purposes(graph.structural_facts(raw), purposes), stored)
