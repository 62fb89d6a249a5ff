import random
import re

import pytest

from tidemark.llm import decontaminate
from tidemark.llm.queries import QUERIES

RND = random.Random(4)
COMMON = "the of and to in is it that for was on are as with be".split()
RARE = [f"w{i}x" for i in range(4000)]


def prose(n):
    return [RND.choice(COMMON) if RND.random() < 0.45 else RND.choice(RARE) for _ in range(n)]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence_against_brute_force():
    for _ in range(300):
        a, b = [[RND.randrange(6) for _ in range(RND.randrange(1, 90))] for _ in range(2)]
        assert decontaminate.common_subsequence(a, b) == plain_lcs(a, b)


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    items = [prose(RND.choice([15, 25, 40, 60])) for _ in range(40)] + [["tiny", "item"], prose(150)]
    text = lambda words: " ".join(words[:-5]) + ". " + " ".join(words[-5:])
    benchmark = [(i, text(w), "c") for i, w in enumerate(items)] + [(90, None, "c"), (91, " ?! ", "c")]
    docs, leaks = [], set()
    for k in range(120):
        words = prose(RND.randrange(0, 500))
        if k % 3 == 0:
            i = RND.randrange(len(items))
            at = RND.randrange(len(words) + 1)
            words[at:at] = items[i]
            leaks.add((k, i))
        docs.append((k, " ".join(words).capitalize(), 1))
    gapped = [w for j, w in enumerate(items[3]) if j % 9 != 2]
    docs += [(200, " ".join(prose(50) + gapped + prose(50)), 1), (201, None, 1), (202, "", 1), (203, " ".join(prose(30_000) + items[5]), 1), (204, docs[0][1], 1), (None, " ".join(items[7]), 1), (205, "item tiny " + "x " * 100, 1)]
    leaks |= {(200, 3), (203, 5), (None, 7)} | {(204, i) for k, i in leaks if k == 0}
    folder = tmp_path_factory.mktemp("leaks")
    spark.createDataFrame(docs, "doc_id long, text string, item int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string, words string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), leaks, docs, items


def test_planted_items_are_found_and_clean_rows_left_alone(spark, case):
    folder, leaks, docs, items = case
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op2_decontamination"](spark, folder).collect()}
    assert set(got) == leaks
    for (k, i), r in got.items():
        words = re.findall(r"[^\W_]+", next(t for d, t, _ in docs if d == k).lower())
        assert r.lcs == 1.0 or (k, i) == (200, 3)
        if r.exact:
            assert any(words[j : j + len(items[i])] == items[i] for j in range(len(words)))


def test_blocks_of_the_benchmark_agree_and_rows_are_kept(spark, case):
    folder, leaks, docs, _ = case
    table, benchmark = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = decontaminate.find_leaks(table, benchmark, items_at_once=15).collect()
    assert {(r.id, r["item"]) for r in got} == leaks
    kept = decontaminate.without_leaks(table, benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, *_ in docs if k is not None and k not in {d for d, _ in leaks})
    assert kept.columns == table.columns


def test_empty_tables(spark):
    docs, benchmark = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), spark.createDataFrame([(1, "some words here and there")], "item_id long, text string")
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0


def test_copies_among_other_benchmark_words_are_found_whatever_the_cosine(spark):
    rnd = random.Random(8)
    words = [f"b{i}" for i in range(600)]
    items = [[rnd.choice(words) for _ in range(rnd.choice([2, 4, 6, 9, 14, 40]))] for _ in range(300)]
    docs, want = [], set()
    for k, item in enumerate(items):
        around = [rnd.choice(words) for _ in range(300)]
        at = rnd.randrange(len(around))
        docs.append((k, " ".join(around[:at] + item + around[at:])))
    for k, text in docs:
        want |= {(k, i) for i, w in enumerate(items) if f" {' '.join(w)} " in f" {text} "}
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = decontaminate.find_leaks(table, spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    assert {(r.id, r["item"]) for r in got.collect() if r.exact} == want


def test_paraphrases_against_all_windows(spark):
    """Every window of every text against every item by plain subsequences: nothing else is found, and little is missed."""
    rnd = random.Random(12)
    words = lambda n: [rnd.choice(COMMON) if rnd.random() < 0.45 else rnd.choice(RARE) for _ in range(n)]
    items = [words(rnd.choice([14, 20, 30, 40])) for _ in range(16)]
    docs = []
    for k in range(40):
        item, changed = items[k % len(items)], []
        for w in item:
            roll = rnd.random()
            if roll < 0.12:
                changed.append(rnd.choice(RARE))  # another word
            elif roll < 0.2:
                changed += [w, rnd.choice(COMMON)]  # one more
            elif roll > 0.05 + 0.9:
                continue  # one less
            else:
                changed.append(w)
        docs.append(words(rnd.randrange(40)) + changed + words(rnd.randrange(40)))
    want = {}
    for k, text in enumerate(docs):
        padded = -(-len(text) // 32) * 32
        for i, item in enumerate(items):
            blocks = max(3, -(-(len(item) + 15) // 16))
            blocks = 3 if blocks <= 3 else 5 if blocks <= 5 else blocks
            for start in range(0, padded, 16):
                region = text[max(0, start - 16) : start + 16 * blocks + 16]
                lcs = plain_lcs(item, region) / len(item)
                if lcs >= 0.8 or lcs >= 0.6 and plain_lcs(item[-3:], region) / 3 >= 0.75:
                    want[k, i] = max(want.get((k, i), 0), lcs)
    sentence = lambda w: " ".join(w[:-3]) + ". " + " ".join(w[-3:])
    table = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    got = {(r.id, r["item"]): r.lcs for r in decontaminate.find_leaks(table, spark.createDataFrame([(i, sentence(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()}
    assert got.keys() <= want.keys() and all(lcs <= want[key] for key, lcs in got.items())
    assert len(want) >= 30 and len(got) >= 0.95 * len(want)
