import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_simhash import components, plain_fingerprint
from tests.llm.test_substring import brute
from tidemark.llm.tokens import default_vocabulary


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(9)
    real = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in real[:120]]
    passage = real[150].text[:600]
    rows += [(500, "123 456 !!!", "en", "s", 11), (501, None, None, None, None), (502, "", "en", "s", 0)]
    rows += [(510 + k, real[130 + k].text[:300] + " " + passage, "en", "s", 900) for k in range(4)]
    rows += [(520 + k, real[140].text, "en", "s", 1) for k in range(3)] + [rows[0], (None, real[141].text, "en", "s", 1)]
    rows += [(530 + k, real[142 + k].text[:200] + " " + items[k].text + " end", "en", "s", 1) for k in range(4)]
    rnd.shuffle(rows)
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_each_stage_against_brute_force(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        if name == "packing":
            break
        assert docs.columns == columns
        if name == "language_id":
            assert sorted(map(str, after)) == sorted(str(r) for r in before if re.search(r"[^\W\d_]", r.text or ""))
        elif name == "simhash_neardup":
            fps = [plain_fingerprint(r.text) for r in before]
            roots = components(list(range(len(before))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
            groups = defaultdict(list)
            for k, r in enumerate(before):
                groups[roots[k]].append(r)
            assert sorted(str(min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)).doc_id) for g in groups.values()) == sorted(str(r.doc_id) for r in after)
        elif name == "substring_dedup":
            want = brute([r.text for r in before])
            assert sorted((str(r.doc_id), r.text if not x[1] else x[3]) for r, x in zip(before, want, strict=True)) == sorted((str(r.doc_id), r.text) for r in after)
            assert all(r.n_chars == len(r.text) for r in after)
        else:
            items = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
            leaked = lambda t: any(f" {i} " in f" {' '.join(re.findall(r'[^\W_]+', (t or '').lower()))} " for i in items)  # noqa: E731, B023
            assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in before if not leaked(r.text))
            assert len(after) < len(before)
    plain, pieces = Tokenizer.from_file(default_vocabulary()), defaultdict(list)
    for r in after:
        pieces[r.doc_id].append(r)
    for r in before:
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert sum(p.length for p in pieces[r.doc_id]) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces[r.doc_id])


def test_run_gives_the_rows_of_the_last_stage(spark, corpus):
    got = corpus_pipeline.run(spark, corpus)
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 50


def test_stages_on_an_empty_table_and_clashing_columns(spark, corpus, tmp_path):
    odd = "lang_pred", "lang_score", "k1", "h1", "kept", "key", "row"
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    named = docs.limit(0).select("*", *[F.lit("own").alias(c) for c in odd])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, named, corpus).count() == 0
    few = docs.filter("doc_id < 12").select("*", *[F.lit("own").alias(c) for c in odd])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        few = spark.createDataFrame(stage(spark, few, corpus).collect(), few.schema)
        assert few.count() and all(r[c] == "own" for r in few.collect() for c in odd)
    assert corpus_pipeline.pack(spark, few, corpus).count()
