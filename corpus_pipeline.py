"""A training corpus from ``documents``: each stage writes its rows, and the next one reads them.

Language identification drops documents in no language; of near-duplicates one document stays; words under repeated
windows are taken out; documents that hold a benchmark item are dropped; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, packing, simhash, substring
from tidemark.llm.common import Workspace, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents for which a language is found; null and empty texts, and texts without letters, have none.

    Repeated rows are judged each; columns of any names pass through; an empty table gives an empty result.
    """
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id, null ids last.

    By op3's contract (three words, at most 2 of 64 bits); near copies at a five-word similarity of 0.8 mostly stay.
    Null and empty texts are one group; of repeated rows one stays; columns of any names pass through; an empty table
    gives an empty result.
    """
    return simhash.one_of_each_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; every document keeps its row, and its length is that of the new text.

    Null texts stay null with a null length, empty ones empty; a text that is one repeat becomes empty; repeated rows
    are copies, so long ones lose all; columns of any names pass through; an empty table gives an empty result.
    """
    return substring.without_repeats(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none and stay; repeated rows are judged alike; columns of any names pass through; an
    empty table of documents or of items drops nothing.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, all documents in them.

    A null or empty text is its end id alone; null ids and repeated rows are packed like any other; further columns
    are left out; an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_neardup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The stages hash shingles, train models and tokenise, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch():  # what a stage wrote for itself goes when its rows are written
            docs = ws.table(stage(spark, docs, sf_dir), name, compression="zstd")
        if last:
            ws.drop(last)
        last = name
    return docs
