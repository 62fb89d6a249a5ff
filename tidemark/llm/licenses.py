"""License scan by diagonal voting, in DataFrame functions only.

All rolling word k-gram hashes of each text meet the k-grams of the templates in a broadcast hash join.  A match of
text position p with template position t votes for the diagonal p - t.  Votes are summed by diagonal; diagonals that
lie next to each other (words inserted or left out) are merged; a span counts when the template's k-grams that it
holds reach ``min_coverage`` and its words have been compared with the template's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java and RE2 syntax alike; applied to text whose A-Z have been lowered.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.phrase.split()

    @property
    def k(self) -> int:
        """Short phrases vote with word pairs, sentences with four words, which are far rarer in running text."""
        return 2 if len(self.words) < 8 else 4

    @property
    def grams(self) -> int:
        return len(self.words) - self.k + 1


#: Phrases that licenses state about themselves.
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl", "subject to the terms of the mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    Template("boost", "boost software license version 1 0"),
    Template("cc0", "cc0 1 0 universal"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
)


def words_of(text: Column) -> Column:
    """Words of the whole text with A-Z lowered; null gives an empty array."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def _rolling(words: Column, n: Column, k: int) -> Column:
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: _hash(words, i, k))).otherwise(F.array().cast("array<bigint>"))


#: Every text carries this hash once, so that texts without a match keep their row through the join.
_SENTINEL = -1


def template_index(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per k-gram of each template and one for the sentinel; its size is that of the templates."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("template"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.k).alias("k"), F.lit(len(t.words)).alias("t_words"), F.lit(t.grams).alias("t_grams"), F.array(*map(F.lit, t.words)).alias("t"))
        for n, t in enumerate(templates)
    ])
    grams = (
        spark.range(1).select(F.inline(rows))
        .withColumn("t_pos", F.explode(F.sequence(F.lit(0), F.col("t_grams") - 1)))
        .withColumn("h", F.when(F.col("k") == 2, _hash(F.col("t"), F.col("t_pos"), 2)).otherwise(_hash(F.col("t"), F.col("t_pos"), 4)))
        .withColumn("gram", F.slice("t", F.col("t_pos") + 1, F.col("k"))).drop("t")
    )
    none = spark.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("k"), F.lit(0).alias("t_words"), F.lit(1).alias("t_grams"), F.lit(0).alias("t_pos"), F.lit(_SENTINEL).cast("bigint").alias("h"), F.array().cast("array<string>").alias("gram"))
    return grams.unionByName(none)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, min_coverage: float = 0.75, max_shift: int = 3) -> DataFrame:
    """One row per input row: ``(id, n_words, spans)``.

    ``spans`` is an array of ``(start, end, label, base, exact, coverage)``, words counted from 0, ``end`` exclusive.
    Exact places of a template are spans of their own; merged spans cover the rest of templates of five words or more.
    Null and empty texts give 0 words and no spans; repeated rows and null ids keep their own row each; other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    words, n = F.col("_words"), F.col("_n")
    pairs = F.greatest(n - 1, F.lit(0))
    rolled = (
        docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_uid"), words_of(F.col(text_col)).alias("_words"))
        .withColumn("_n", F.size("_words"))
        .select("_uid", "_id", "_n", "_words", F.concat(F.array(F.lit(_SENTINEL).cast("bigint")), _rolling(words, n, 2), _rolling(words, n, 4)).alias("_hashes"))
        .select("_uid", "_id", "_n", "_words", F.posexplode("_hashes").alias("_slot", "h"))
    )
    position = F.when(F.col("_slot") == 0, 0).when(F.col("_slot") <= pairs, F.col("_slot") - 1).otherwise(F.col("_slot") - 1 - pairs)
    matches = (
        rolled.join(F.broadcast(template_index(spark, templates)), "h")
        .withColumn("_pos", position)
        .filter(F.slice("_words", F.col("_pos") + 1, F.col("k")) == F.col("gram"))
        .select("_uid", "_id", "_n", "template", "label", "base", "k", "t_words", "t_grams", "t_pos", (F.col("_pos") - F.col("t_pos")).alias("diagonal"))
        .repartition("_uid")  # the one shuffle: all that follows is by text
    )
    text = ["_uid", "_id", "_n"]
    kind = ["template", "label", "base", "k", "t_words", "t_grams"]
    votes = matches.groupBy(*text, *kind, "diagonal").agg(F.collect_set("t_pos").alias("hit"))
    full = F.size("hit") == F.col("t_grams")
    order = Window.partitionBy("_uid", "template", "_merge").orderBy("diagonal")
    chained = (
        votes.withColumn("_merge", ~full & (F.col("t_words") >= 5))
        .withColumn("_gap", F.when(~F.col("_merge"), 1).otherwise(F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= max_shift, 0).otherwise(1)))
        .withColumn("_chain", F.sum("_gap").over(order))
    )
    spans = (
        chained.groupBy(*text, *kind, "_merge", "_chain")
        .agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.min(F.col("diagonal") + F.array_min("hit")).alias("start"), F.max(F.col("diagonal") + F.array_max("hit") + F.col("k")).alias("end"))
        .withColumn("coverage", F.size("hit") / F.col("t_grams"))
        .withColumn("ok", (F.col("template") >= 0) & F.when(F.col("_merge"), (F.col("coverage") >= min_coverage) & (F.col("end") - F.col("start") <= F.col("t_words") + 2 * max_shift)).otherwise(F.col("coverage") == 1))
        .withColumn("span", F.when(F.col("ok"), F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "label", "base", (~F.col("_merge")).alias("exact"), "coverage")))
    )
    return spans.groupBy(*text).agg(F.array_sort(F.collect_list("span")).alias("spans")).select(F.col("_id").alias(id_col), F.col("_n").cast("bigint").alias("n_words"), "spans")
