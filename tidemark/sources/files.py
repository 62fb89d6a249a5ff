"""Directories and manifests as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import ascii_lower, extension

#: What a source tree scan takes and leaves by default.
EXTENSIONS = (".h", ".hpp", ".cpp", ".inl", ".inc")
EXCLUDED = (".git", "binaries", "intermediate", "deriveddatacache", "saved")


def _wanted(path: Column, extensions: tuple[str, ...], excluded: tuple[str, ...]) -> Column:
    parts = F.split(ascii_lower(path), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.concat(F.lit("."), extension(path)).isin([e.lower() for e in extensions]) & ~F.exists(folders, lambda p: p.isin([e.lower() for e in excluded]))


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """``(relative_path, size_bytes)`` by lower-case path, then path; contents are not read; empty files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    relative = F.substring(F.regexp_replace("path", "^file:/+", "file:/"), len(base) + 2, 1 << 20)
    rows = files.select(relative.alias("relative_path"), F.col("length").alias("size_bytes"))
    return filter_entries(rows, extensions, excluded)


def filter_entries(entries: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    return entries.filter(_wanted(F.col("relative_path"), extensions, excluded)).orderBy(ascii_lower(F.col("relative_path")), "relative_path")


def read_texts(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """``(relative_path, text)`` of the files of a scan; bytes that are no UTF-8 are replaced."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.substring(F.regexp_replace("path", "^file:/+", "file:/"), len(base) + 2, 1 << 20)
    rows = files.select(relative.alias("relative_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return rows.filter(_wanted(F.col("relative_path"), extensions, excluded))


def remembered_file(files: DataFrame) -> DataFrame:
    """Frames of ``files(relative_path, text)`` with the file's metadata; empty files raise an error."""
    checked = files.withColumn("text", F.when(F.coalesce("text", F.lit("")) == "", F.raise_error(F.concat(F.lit("empty file "), F.col("relative_path")))).otherwise(F.col("text")))
    name = F.element_at(F.split("relative_path", "/"), -1)
    meta = F.create_map(F.lit("source_kind"), F.lit("file"), F.lit("uri"), F.col("relative_path"), F.lit("filename"), name, F.lit("extension"), extension(F.col("relative_path")))
    return checked.select("text", meta.alias("metadata"))


CHUNK_MANIFEST = "chunk_id string, relative_path string, language string, symbol string, line_start int, line_end int, token_estimate int, content_hash string, size_bytes long"
FILE_MANIFEST = "relative_path string, size_bytes long, content_hash string"


def read_manifest(spark: SparkSession, path: str, schema: str = FILE_MANIFEST) -> DataFrame:
    """Tab-separated rows; malformed ones are left out."""
    return spark.read.csv(path, sep="\t", schema=schema, mode="DROPMALFORMED", quote="", comment="#")


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", quote="")


def read_checkpoint(spark: SparkSession, path: str) -> dict[str, str]:
    """``key=value`` lines."""
    rows = spark.read.text(path).filter(F.contains("value", F.lit("="))).collect()
    return dict(r["value"].split("=", 1) for r in rows)


def write_checkpoint(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    spark.createDataFrame([(f"{k}={v}",) for k, v in sorted(values.items())], "value string").coalesce(1).write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    """JSON lines, for recall and access logs."""
    rows.write.mode("append").json(path)
