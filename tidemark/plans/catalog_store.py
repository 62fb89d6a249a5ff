"""Queries that go through files: stores, engines, manifests, directories and the index job, each in a folder of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import chunks, maintain, store
from tidemark.operators.common import shared_folder
from tidemark.plans import tables as T
from tidemark.plans.catalog import FRAMES, LIVES, LOG, VERSIONS, _LATEST, query
from tidemark.plans.catalog_more import SYMBOLS, symbol_files
from tidemark.plans.engine import Engine
from tidemark.sources import files
from tidemark.streaming import streams


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


def _stored(spark, d) -> store.FrameStore:
    """Frames in two commits, and their lengths as another table."""
    own, frames = store.FrameStore(spark, _folder(spark)), T.frames(spark, d).withColumn("sha256", F.sha2("text", 256))
    own.commit({"frames": frames.filter("frame_id % 3 <> 0"), "lengths": frames.select("frame_id", F.length("text").alias("n"))})
    own.commit(append={"frames": frames.filter("frame_id % 3 = 0")})
    return own


@query(f"WITH {FRAMES} SELECT frame_id, sha256(text) AS digest, length(text) AS n FROM frames WHERE status = 0 AND superseded_by IS NULL")
def store_compact(spark, d):
    own = _stored(spark, d)
    own.compact()
    return own.read("frames").join(own.read("lengths"), "frame_id", "left").select("frame_id", F.sha2("text", 256).alias("digest"), F.col("n").cast("bigint").alias("n"))


@query("SELECT 'frames' AS \"table\", 2 AS parts, count(*) AS rows FROM documents UNION ALL SELECT 'lengths', 1, count(*) FROM documents")
def store_report(spark, d):
    return _stored(spark, d).report().select("table", "parts", "rows")


@query("SELECT doc_id AS frame_id, doc_id % 3 = 0 AS later FROM documents")
def store_staged(spark, d):
    """What is staged is seen by its writer only; rolled back, it is gone."""
    own = _stored(spark, d)
    before = own.read("frames", generation=0).select("frame_id", F.lit(False).alias("later"))
    own.stage({}, {"frames": T.frames(spark, d)})
    assert own.read("frames", staged=True).count() == 2 * own.read("frames").count()
    own.rollback()
    return before.union(own.read("frames").join(before, "frame_id", "left_anti").select("frame_id", F.lit(True)))


@query(f"WITH {LOG}, {LIVES}, {VERSIONS} {_LATEST}")
def engine_facts(spark, d):
    e = Engine(spark, _folder(spark))
    log = T.fact_log(spark, d).drop("pinned").withColumns({"metadata": F.create_map().cast("map<string,string>"), "supersedes": F.lit(None).cast("bigint")})
    for part in (0, 1):
        e.store.commit(append={"fact_log": log.filter(F.col("seq") % 2 == part)})
    return e.facts().select("entity", "attribute", "value", "id", "version")


@query("SELECT vec_id AS frame_id, round(embedding[1]::DOUBLE * CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END, 6) AS first FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)")
def engine_vectors(spark, d):
    e = Engine(spark, _folder(spark))
    e.store.commit({"frames": T.read(spark, d, "documents").select(F.col("doc_id").alias("frame_id"), F.lit(0).alias("status"), F.lit(None).cast("bigint").alias("superseded_by"))})
    v = T.vectors(spark, d).join(e.store.read("frames"), "frame_id", "left_semi").select("frame_id", F.col("embedding").cast("array<double>").alias("embedding"))
    e.put_embeddings(v)
    e.put_embeddings(v.filter("frame_id % 4 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * 2)))
    return e.vectors().select("frame_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@query(f"WITH {FRAMES} SELECT frame_id, sha256(text) AS digest FROM frames WHERE frame_id % 11 = 4 AND NOT starts_with(text, 'T')")
def engine_contents(spark, d):
    e = Engine(spark, _folder(spark), internal=("T",))
    e.store.commit({"frames": T.frames(spark, d)})
    return e.contents(T.frames(spark, d).select("frame_id").filter("frame_id % 11 = 4")).select("frame_id", F.sha2("text", 256).alias("digest"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS frame_id, doc_id AS ts_ms, sha256(text) AS digest FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r\\f\\x0B]')")
def engine_remember(spark, d):
    e = Engine(spark, _folder(spark))
    docs = T.read(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("ts_ms"), "text", F.create_map(F.lit("lang"), "lang").alias("metadata"))
    e.remember(docs, target=1 << 30)
    return e.frames().select("frame_id", "ts_ms", F.sha2("text", 256).alias("digest"))


@query("SELECT 'site/' || page_id || '.html' AS relative_path, octet_length(encode(html))::BIGINT AS size_bytes FROM pages")
def file_manifest(spark, d):
    path = _folder(spark)
    files.write_manifest(chunks.file_digests(T.files(spark, d)), path)
    spark.createDataFrame([("no\tnumber\tx",), ("# a remark",)], "value string").coalesce(1).write.mode("append").text(path)
    return files.read_manifest(spark, path).select("relative_path", "size_bytes")


_TREE = {"Source/A.cpp": "int a;", "Source/b.H": "int b;", "Source/Saved/c.cpp": "x", "docs/d.md": "y", "Source/e.inl": "é", "z.hpp": "z", ".git/f.h": "q"}


def _tree(spark) -> str:
    path, hadoop = _folder(spark), spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, text in _TREE.items():
        out = fs.create(hadoop(f"{path}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()
    return path


@query("SELECT * FROM (VALUES ('Source/A.cpp', 6::BIGINT), ('Source/b.H', 6), ('Source/e.inl', 2), ('z.hpp', 1)) t(relative_path, size_bytes)")
def directory_scan(spark, d):
    return files.scan(spark, _tree(spark))


@query("SELECT * FROM (VALUES ('Source/A.cpp', 'int a;', 'A.cpp', 'cpp'), ('Source/b.H', 'int b;', 'b.H', 'h'), ('Source/e.inl', 'é', 'e.inl', 'inl'), ('z.hpp', 'z', 'z.hpp', 'hpp')) t(uri, text, filename, extension)")
def remembered_files(spark, d):
    rows = files.remembered_file(files.read_texts(spark, _tree(spark)).filter("text <> ''"))
    return rows.select(F.col("metadata")["uri"].alias("uri"), "text", F.col("metadata")["filename"].alias("filename"), F.col("metadata")["extension"].alias("extension"))


@query(SYMBOLS)
def index_job(spark, d):
    """The files of ``symbols`` through the index job, from a stream of Parquet files."""
    path, own = _folder(spark), store.FrameStore(spark, _folder(spark))
    symbol_files(spark, d).repartition(3).write.parquet(path)
    stream = spark.readStream.schema("relative_path string, text string").option("maxFilesPerTrigger", 2).parquet(path)
    streams.ingest_stream(stream, own).awaitTermination()
    return streams.indexed(own).select("relative_path", "symbol", "chunk_id")


@query("SELECT event_id % 997 AS frame_id, count(*) AS accesses FROM events GROUP BY 1")
def access_export(spark, d):
    """Access statistics written as a log and read back."""
    path = _folder(spark)
    files.append_log(maintain.access_stats(T.access_log(spark, d)), path)
    return maintain.merge_access(spark.read.schema("frame_id long, accesses long, first_ms long, last_ms long").json(path)).select("frame_id", "accesses")
