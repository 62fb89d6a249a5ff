import os
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import shards
from tidemark.llm.queries import QUERIES
from tidemark.llm.tokens import default_vocabulary


@pytest.mark.parametrize("total", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(total):
    got = shards.feistel(np.arange(total), total, 9)
    assert sorted(got.tolist()) == list(range(total))
    assert total < 100 or (got != shards.feistel(np.arange(total), total, 10)).any()


def test_round_trip_and_resuming(spark, tmp_path):
    texts = [None, "", "one two three", "word " * 700, "é ü", "word " * 700] * 7
    docs = spark.createDataFrame([(None if i == 4 else i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, shard int").repartition(3)
    docs = spark.createDataFrame(docs.collect(), docs.schema).repartition(1)
    options = {"folder": str(tmp_path / "shards"), "length": 64, "per_shard": 16}
    index = sorted(shards.write_shards(docs, **options).collect(), key=lambda r: r.slot)
    assert [r.slot for r in index] == list(range(len(index))) and sorted(r.sequence for r in index) == list(range(len(index)))
    records = list(shards.read_from(options["folder"], 0, 64, 16))
    assert len(records) == len(index) and all(zlib.crc32(x.tobytes()) == r.crc32 for x, r in zip(records, index, strict=True))
    assert [x.tolist() for x in shards.read_from(options["folder"], 21, 64, 16)] == [x.tolist() for x in records[21:]]
    got = {}
    for r in sorted(index, key=lambda r: r.sequence):
        ends = [*r.starts[1:], r.n_tokens]
        for k, a, b in zip(r.docs, r.starts, ends, strict=True):
            got.setdefault(k, []).extend(records[r.slot][a:b].tolist())
    plain = Tokenizer.from_file(default_vocabulary())
    assert got == {(None if i == 4 else i): [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    name = f"{options['folder']}/shard-000001.bin"
    before = {n: os.stat(f"{options['folder']}/{n}").st_mtime_ns for n in os.listdir(options["folder"])}
    with open(name, "r+b") as f:
        f.truncate(100)
    assert sorted(shards.write_shards(docs, **options).collect(), key=lambda r: r.slot) == index
    after = {n: os.stat(f"{options['folder']}/{n}").st_mtime_ns for n in os.listdir(options["folder"])}
    assert {n for n in before if before[n] != after.get(n)} == {"shard-000001.bin"} and before.keys() == after.keys()
    assert [x.tolist() for x in shards.read_from(options["folder"], 0, 64, 16)] == [x.tolist() for x in records]


def test_query_and_empty_table(spark):
    got = QUERIES["op6_training_shards"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and {k for r in got for k in r.doc_ids} == set(range(200))
    assert shards.write_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_of_another_type_are_kept(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, "three"), ("b", None)], "doc_id string, text string").coalesce(1)
    assert [r.docs for r in shards.write_shards(docs).collect()] == [["a", None, "b"]]
