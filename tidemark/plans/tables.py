"""The driver's tables in the roles of this engine: frames, queries, vectors, facts, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as frames: one a minute, some deleted, some superseded by the next."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("frame_id"), (F.col("doc_id") * 60_000).alias("ts_ms"), "text", F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0).alias("status"),
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"), F.array("lang", "source").alias("labels"),
        F.when(F.col("doc_id") % 17 == 0, F.col("doc_id") + 1).alias("superseded_by"), F.when(F.col("doc_id") % 17 == 1, F.col("doc_id") - 1).alias("supersedes"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def fact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations on facts: an error removes the fact, anything else sets its value."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "remove").otherwise("upsert").alias("op"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity"),
        F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")).alias("attribute"), F.col("props").alias("value"), F.col("event_id").alias("id"), (F.unix_seconds(F.col("ts").cast("timestamp")) * 1000).alias("ts_ms"), F.lit(False).alias("pinned"),
    )


def eav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, suppliers and customers as facts with values."""
    def of(table: str, key: str, kind: str, *columns: str) -> DataFrame:
        rows = read(spark, sf_dir, table)
        parts = [F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns]
        return rows.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("entity"), F.col(key).cast("bigint").alias("id"), F.inline(F.array(*parts)))

    return of("nation", "n_nationkey", "nation", "n_name", "n_regionkey").unionByName(of("supplier", "s_suppkey", "supplier", "s_name", "s_nationkey")).unionByName(of("customer", "c_custkey", "customer", "c_name", "c_mktsegment", "c_nationkey"))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a mutation log: each puts a frame; some then delete an earlier one or supersede it."""
    e = read(spark, sf_dir, "events").select("event_id", "props")
    put = e.select((F.col("event_id") * 2).alias("seq"), F.lit("put").alias("kind"), F.col("event_id").alias("frame_id"), F.lit(None).cast("bigint").alias("other_id"), (F.col("event_id") * 1000).alias("ts_ms"), F.col("props").alias("text"))
    gone = e.filter("event_id % 7 = 3").select((F.col("event_id") * 2 + 1).alias("seq"), F.lit("delete").alias("kind"), F.expr("event_id div 2").alias("frame_id"), F.lit(None).cast("bigint").alias("other_id"), (F.col("event_id") * 1000).alias("ts_ms"), F.lit(None).cast("string").alias("text"))
    over = e.filter("event_id % 11 = 5 and event_id % 7 <> 3").select((F.col("event_id") * 2 + 1).alias("seq"), F.lit("supersede").alias("kind"), (F.col("event_id") - 5).alias("frame_id"), F.col("event_id").alias("other_id"), (F.col("event_id") * 1000).alias("ts_ms"), F.lit(None).cast("string").alias("text"))
    return put.unionByName(gone).unionByName(over)


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 997).alias("frame_id"), (F.unix_seconds(F.col("ts").cast("timestamp")) * 1000).alias("ts_ms"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the path is what follows the host."""
    return read(spark, sf_dir, "pages").select(F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".html")).alias("relative_path"), F.col("html").alias("text"), "page_id")


def graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as graph documents: an event node, then a call for each line in turn."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    node = lambda guid, kind, title: [guid.alias("node_guid"), F.lit(f"/Script/BlueprintGraph.{kind}").alias("class_path"), title.alias("title")]
    none = F.lit(None).cast("struct<member_name:string,member_parent:string>")
    call = F.transform("lines", lambda x, i: F.struct(*node((i + 1).cast("string"), "K2Node_CallFunction", F.lit("call")), none.alias("event_ref"), F.struct(F.concat(F.lit("Part"), x["l_partkey"].cast("string")).alias("member_name"), F.concat(F.lit("/Script/Game.Supplier"), x["l_suppkey"].cast("string")).alias("member_parent")).alias("function")))
    start = F.struct(*node(F.lit("0"), "K2Node_Event", F.lit("start")), F.struct(F.lit("Begin").alias("member_name"), F.lit("/Script/Engine.Actor").alias("member_parent")).alias("event_ref"), none.alias("function"))
    links = F.transform("lines", lambda x, i: F.struct(i.cast("string").alias("from_node_guid"), F.lit("then").alias("from_pin_name"), (i + 1).cast("string").alias("to_node_guid"), F.lit("execute").alias("to_pin_name")))
    graph = F.struct(F.lit("EventGraph").alias("name"), F.concat(F.array(start), call).alias("nodes"), links.alias("links"))
    prefix = F.when(F.col("l_orderkey") % 3 == 0, "GA_").when(F.col("l_orderkey") % 3 == 1, "W_").otherwise("BP_")
    doc = F.struct(F.concat(prefix, F.col("l_orderkey").cast("string")).alias("asset_name"), F.lit("/Game/Orders").alias("asset_path"), F.array(graph).alias("graphs"))
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.to_json(doc).alias("json"))
