"""The queries ``opN_*``: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html_text, langid, licenses, neighbours, packing, shards, simhash, substring, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"] & s["exact"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.round(F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)), 6).alias("score"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("cosine", 4).alias("cosine"), "lcs", "answer", F.col("start").alias("start_word"), "exact")


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_report(substring.find_repeats(_read(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = warc.round_trip(_read(spark, sf_dir, "pages"), with_data=False).filter("is_last")
    return last.select(F.col("record_key").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


def op6_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = shards.write_shards(_read(spark, sf_dir, "documents"))
    return index.select("slot", "sequence", "shard", "byte_offset", "n_tokens", "crc32", F.array_distinct("docs").alias("doc_ids"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op9_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontamination": op2_decontamination,
    "op3_simhash_neardup": op3_simhash_neardup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_training_shards": op6_training_shards,
    "op7_html_main_text": op7_html_main_text,
    "op8_curve_packing": op8_curve_packing,
    "op9_forest_neighbours": op9_forest_neighbours,
    "op10_language_id": op10_language_id,
}
