import zlib

import pytest

from tidemark.llm import langid
from tidemark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def test_languages_without_letters_nulls_and_clashing_columns(spark, model):
    rows = [(1, None, 5), (2, "", 5), (3, "123 !!! \n", 5), (4, "The thing and the other with that " * 3, 5), (4, "the " * 600_000, 5), (None, "É", 5)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred int"), model).collect()
    assert [(r.lang_pred, r.lang_score) for r in got[:3]] == [("und", 0.0)] * 3
    assert got[3].lang_pred == "en" and got[4].lang_pred != "und" and got[5].lang_pred in ("en", "de", "fr", "es") and len(got) == 6


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(0, "some text", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert [(r.lang_pred, r.lang_score) for r in langid.identify(docs, model).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0), model).count() == 0


def test_families_and_pairs(model):
    assert set(model.families) == {"germanic", "romance"} and set(model.pairs) == {("de", "en"), ("es", "fr")}


def test_only_letters_count_above_the_first_plane_too():
    assert langid.features("\U0001F600\U0001F680 \U0001F600 123") is None
    assert langid.features("\U00010400\U00010428") is not None and langid.features("\U00020000") is not None
    plain, mixed = langid.features("some words here"), langid.features("some \U0001F600 words \U0001F680 here")
    assert all((a == b).all() for a, b in zip(plain, mixed, strict=True))
