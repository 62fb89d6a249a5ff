import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import substring
from tidemark.llm.common import Workspace
from tidemark.llm.queries import QUERIES


def brute(texts, window=35):
    words = [[w for w in (t or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w] for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def corpus():
    rnd = random.Random(11)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(400))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, long_one = text(60), text(34)
    texts = [None, "", " \x0b\t", text(34), text(35), "w " * 300, "w " * 36, "Ein É\x85ü Ö\xa0wort " + text(50)]
    texts += [text(rnd.randrange(300)) + " " + passage + "\n" + text(rnd.randrange(90)) for _ in range(12)]
    texts += [text(20) + " " + long_one + " x" + str(i) for i in range(3)]
    copy = text(200)
    texts += [copy, copy, copy.replace(" ", "\n"), copy + " end", text(10) + " " + copy[:400], text(35), passage[:-1], text(20_000)]
    p = text(40)
    texts += [p + " middle " + p]
    texts += [texts[4]] * 2
    return texts


def test_query_against_brute_force(spark, tmp_path):
    texts = corpus()
    spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, k1 int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op4_substring_dedup"](spark, str(tmp_path)).collect()}
    assert got == {i: x[:3] for i, x in enumerate(brute(texts))}


def test_batches_of_the_log_agree_and_texts_are_cut(spark):
    texts = corpus()
    docs = spark.createDataFrame([(None if i % 9 == 0 else i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, hash string")
    want = brute(texts)
    for batches in (1, 5):
        got = substring.without_repeats(docs, batches=batches).collect()
        assert sorted(r.text or "" for r in got) == sorted((t or "") if not x[1] else x[3] for t, x in zip(texts, want, strict=True))
        assert got[0].asDict().keys() == {"doc_id", "text", "hash"}
    assert substring.without_repeats(docs.limit(0)).count() == 0


def test_log_against_counting_and_reopened(spark, tmp_path):
    ws = Workspace(spark, "test")
    path, seen, hits, want = f"file://{tmp_path}/log", set(), [], []
    for k, batch in enumerate(((5, 3, 9, 9), (3, 4), (4, 8, 1), (1, 2), (), (2, 3, 3))):
        log = substring.FingerprintLog(spark, path, buckets=3)
        hits.append(sorted(r.hash for r in log.add(spark.createDataFrame([(x,) for x in batch], "hash long"), ws).collect()))
        want.append(sorted({x for x in batch if x in seen or batch.count(x) > 1}))
        seen.update(batch)
        assert [level for _, level in log.runs] == [[0], [1], [1, 0], [2], [2, 0], [2, 1]][k]
        log.close()
    assert hits == want
    log = substring.FingerprintLog(spark, path)
    rows = [(r.hash, r.n) for name, _ in log.runs for r in log._read(name).collect()]
    assert log.buckets == 3 and sum(n for _, n in rows) == 14 and {h for h, _ in rows} == seen
    log.close()
    ws.close()


def test_runs_meet_without_shuffle_or_sort(spark, tmp_path):
    ws = Workspace(spark, "test")
    log = substring.FingerprintLog(spark, f"file://{tmp_path}/log", buckets=4)
    a, b = (log._read(log._run(spark.range(n, 30_000 + n).selectExpr("xxhash64(id) as hash").groupBy("hash").agg(F.count("*").alias("n")))) for n in (0, 100))
    with log._sorted():
        plan = a.join(b.hint("merge"), "hash")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    log.close()
    ws.close()


def test_batch_after_batch_against_brute_force(spark, tmp_path):
    texts = corpus()
    rnd = random.Random(2)
    rnd.shuffle(texts)
    shares = [texts[:9], texts[9:20], [], texts[20:]]
    before = []
    for share in shares:
        index = substring.PassageIndex(spark, f"file://{tmp_path}/index", buckets=4)  # opened anew for each batch
        docs = spark.createDataFrame(list(enumerate(share)), "doc_id long, text string")
        got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_report(index.add(docs)).collect()}
        before += share
        assert got == {i: x[:3] for i, x in enumerate(brute(before)[len(before) - len(share) :])}
        index.close()
