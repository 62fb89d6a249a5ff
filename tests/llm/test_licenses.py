import re

from pyspark.sql import types as T

from tidemark.llm import licenses
from tidemark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, label string, spans int"
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, k) for k, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({k for _, k in found}))


def test_base_places_against_brute_force(spark, tmp_path):
    texts = [
        None, "", "MIT", "Released under the MIT License.", "mit license mit license, MIT-License", "mit  licenses", "the GNU General\nPublic License version 3; Apache\tLicense",
        "general public public license", "ÉMIT license mit éclair license", "x " * 3000 + "apache license", "mit license " * 500, "!!! ...", "Released under the MIT License.",
    ]
    rows = [(i if i != 3 else None, t, "clash", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_license_scan"](spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    want = sorted((-1 if i is None else i, *brute(t)) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_merged_diagonals_find_changed_notices(spark):
    t = licenses.TEMPLATES[3].phrase.split()
    changed = " ".join([*t[:9], "really", *t[9:]])
    rows = [(0, "a b c " + changed + " d"), (1, " ".join(t[:8])), (2, "permission of the of this software and of")]
    got = {r.doc_id: r.spans for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    (span,) = got[0]
    assert (span.label, span.exact, span.start, span.end) == ("mit", False, 3, 3 + len(t) + 1) and 0.75 <= span.coverage < 1
    assert got[1] == [] and got[2] == []


def test_empty_table_and_no_python(spark):
    none = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    found = licenses.scan_licenses(none)
    assert found.count() == 0
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "BroadcastHashJoin" in plan
