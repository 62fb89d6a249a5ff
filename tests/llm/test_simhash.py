import random

import xxhash

from tidemark.llm import simhash
from tidemark.llm.common import Workspace
from tidemark.llm.components import connected_components
from tidemark.llm.queries import QUERIES


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def components(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 3, 8, 120, 400]))) for _ in range(60)]
    texts = [None, "", " \t\n", "ONE", "one\x0btwo", "a b c", "É x y z", "x " * 20000]
    for t in base:
        texts += [t, t.upper()] + [t + " tail" * k for k in range(3)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, fp string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash_neardup"](spark, str(tmp_path)).collect()}
    fps = {i: plain_fingerprint(t) for i, t, _ in rows}
    roots = components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert got == {i: (f"{fps[i]:016x}", roots[i]) for i in fps}


def test_links_of_crowded_lists_equal_brute_force(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(60):
            y = x
            for _ in range(rnd.randrange(5)):
                y ^= 1 << rnd.randrange(64)
            fps.add(y - (1 << 64) if y >> 63 else y)
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bits in (1, 2):
        want = components(sorted(fps), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= bits)
        for light in (2, 10_000):
            ws = Workspace(spark, "test")
            got = {r.node: r.root for r in connected_components(simhash.links(table, ws, bits, light), ws).collect()}
            assert {k: got.get(k, k) for k in fps} == want
            ws.close()


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (None, "zz yy xx")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.component_id is None, r.component_size) for r in got) == [(False, 3)] * 3 + [(True, 1)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_chain_settles(spark):
    ws = Workspace(spark, "test")
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in connected_components(edges, ws).collect()} == {0}
    ws.close()
