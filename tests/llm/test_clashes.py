"""Operators that return the input's columns leave those named like their own alone."""

from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, simhash, substring

SCHEMA = "doc_id long, text string, k1 string, k2 string, _row string, kept string, id string, row string, words string, fp string, h1 string, lang_pred string, lang_score string, lang string"


def test_columns_of_the_same_names_stay(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, "alpha " + long, *"abcdefgh1234"), (2, "beta " + long, *"ijklmnop5678"), (3, "an item of ten words that nobody else would write", *"qrstuvwx9012"), (None, None, *[None] * 12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    benchmark = spark.createDataFrame([(5, "an item of ten words that nobody else would write")], "item_id long, text string")
    want = {str(r[2:]) for r in rows}
    for got in (substring.without_repeats(docs), simhash.one_of_each_group(docs, max_bits=1), decontaminate.without_leaks(docs, benchmark), langid.keep_identified(docs, langid.train(docs))):
        assert got.columns == docs.columns
        found = {str(tuple(r)[2:]) for r in got.collect()}
        assert found <= want and len(found) >= 3
    assert sorted(r.text or "" for r in substring.without_repeats(docs).collect()) == ["", "alpha", rows[2][1], "beta"]


def test_repeated_rows_keep_one_and_empty_tables_stay_empty(spark):
    rows = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, "x y z w"), (None, None), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.text or "") for r in simhash.one_of_each_group(docs).collect())
    assert got == [("1", "alpha beta gamma"), ("2", "x y z w"), ("None", "")]
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0
    assert langid.keep_identified(docs, langid.train(docs.withColumn("lang", F.lit(None)))).count() == 0
