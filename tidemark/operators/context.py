"""Token-budgeted contexts, citations and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import first_words, prompt_tokens, truncate_bytes, words
from tidemark.operators.fusion import drop_repeated_text


def build_context(results: DataFrame, k: int = 24, preview_bytes: int = 512, expansion: int = 600, context: int = 1500, snippet: int = 200, max_snippets: int = 24) -> DataFrame:
    """``(query_id, position, kind, frame_id, score, text, tokens)`` of ``results(query_id, frame_id, score, preview)``.

    The best row is expanded, the others are snippets, each held to its own cap and all of them to the context's budget;
    rows go by score, ties by id, and equal texts count once.  The running sum of capped word counts says what is left
    for each row, so one window does it.
    """
    ordered = results.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("frame_id"))))
    if k > 0:
        ordered = ordered.filter(F.col("pos") <= k)
    text = truncate_bytes(F.coalesce("preview", F.lit("")), preview_bytes)
    rows = ordered.withColumn("text", F.when(text == "", F.concat(F.lit("frame "), F.col("frame_id").cast("string"))).otherwise(text))
    rows = drop_repeated_text(rows, "text", "pos").withColumn("n", F.size(words(F.col("text")))).filter("n > 0")
    by = Window.partitionBy("query_id").orderBy("pos")
    exp = min(expansion, context)
    place = F.row_number().over(by) - 1
    rows = rows.withColumn("p", place).withColumn("expanded", (F.col("p") == 0) & F.lit(exp > 0)).withColumn("s", F.col("p") + (0 if exp > 0 else 1))
    rows = rows.filter(F.col("expanded") | ((F.col("s") <= max_snippets) & F.lit(snippet > 0)))
    rows = rows.withColumn("want", F.least("n", F.when(F.col("expanded"), exp).otherwise(snippet)))
    before = F.coalesce(F.sum("want").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("tokens", F.greatest(F.lit(0), F.least("want", context - before)).cast("int")).filter("tokens > 0")
    cut = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("tokens")), " ")
    return rows.select("query_id", F.row_number().over(by).alias("position"), F.when(F.col("expanded"), "expanded").otherwise("snippet").alias("kind"), "frame_id", "score", F.when(F.col("tokens") < F.col("n"), cut).otherwise(F.array_join(words(F.col("text")), " ")).alias("text"), "tokens")


def citations(items: DataFrame, frames: DataFrame, limit: int = 10) -> DataFrame:
    """``(query_id, citation, frame_id, score, path)``: each frame's first item among the first ``limit``, best score first."""
    head = items.filter(F.col("position") <= limit)
    first = head.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "frame_id").orderBy("position"))).filter("_n = 1")
    path = F.coalesce(F.col("metadata")["relative_path"], F.col("metadata")["uri"], F.lit(""))
    joined = first.join(frames.select("frame_id", path.alias("path")), "frame_id", "left")
    return joined.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), F.asc("frame_id"))).alias("citation"), "frame_id", "score", "path")


def answer_prompt(items: DataFrame, queries: DataFrame, max_items: int = 10, max_tokens: int = 4000) -> DataFrame:
    """``(query_id, prompt, prompt_tokens)``: numbered items within the budget, then the question."""
    numbered = items.filter(F.col("position") <= max_items).withColumn("cost", prompt_tokens(F.col("text")))
    by = Window.partitionBy("query_id").orderBy("position")
    fit = numbered.withColumn("sum", F.sum("cost").over(by)).filter(F.col("sum") <= max_tokens)
    blocks = fit.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", F.format_string("[%d] %s", "position", "text").alias("line")))).alias("lines"))
    made = queries.join(blocks, "query_id", "left").withColumn("context", F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("")))
    prompt = F.concat(F.lit("Answer from the numbered context only and cite it by number.\n\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("query"))
    return made.select("query_id", prompt.alias("prompt")).withColumn("prompt_tokens", prompt_tokens(F.col("prompt")))


def preview(frames: DataFrame, n: int = 24) -> DataFrame:
    return frames.select("frame_id", first_words(F.col("text"), n).alias("preview"))
