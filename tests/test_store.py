import base64
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunks, facts, maintain, store
from tidemark.plans.engine import Engine
from tidemark.streaming import streams

LOG = "seq long, kind string, frame_id long, other_id long, ts_ms long, text string"


def test_fold_against_a_model(spark):
    rnd, rows, frames = random.Random(1), [], {}
    for seq in range(400):
        n = len(frames)
        if n < 5 or rnd.random() < 0.5:
            frames[n] = [0, None, None, f"t{n}"]
            rows.append((seq, "put", n, None, seq, f"t{n}"))
        elif rnd.random() < 0.5:
            k = rnd.randrange(n)
            frames[k][0] = 1
            rows.append((seq, "delete", k, None, seq, None))
        else:
            a, b = sorted(rnd.sample(range(n), 2))
            if frames[a][2] is None and frames[b][1] is None:
                frames[a][2], frames[b][1] = b, a
                rows.append((seq, "supersede", a, b, seq, None))
    log = spark.createDataFrame(rows, LOG).repartition(4)
    got = {r.frame_id: [r.status, r.supersedes, r.superseded_by, r.text] for r in store.fold_mutations(log).collect()}
    assert got == frames and store.mutation_errors(log).count() == 0


def test_errors_are_named(spark):
    rows = [(0, "put", 0, None, 0, "a"), (1, "put", 1, None, 0, "b"), (2, "put", 9, None, 0, "c"), (3, "delete", 7, None, 0, None), (4, "supersede", 0, 0, 0, None), (5, "supersede", 0, 1, 0, None), (6, "supersede", 1, 0, 0, None), (7, "supersede", 0, 9, 0, None)]
    got = {(r.seq, r.error) for r in store.mutation_errors(spark.createDataFrame(rows, LOG)).collect()}
    assert {(2, "id out of range"), (3, "unknown frame"), (4, "supersedes itself"), (7, "conflicting link"), (6, "cycle")} <= got and (5, "cycle") not in got


def test_generations_commit_and_compact(spark, tmp_path):
    s = store.FrameStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(FileNotFoundError):
        s.read("frames")
    frames = spark.createDataFrame([(0, 0, None, "a"), (1, 1, None, "b"), (2, 0, 3, "c"), (3, 0, None, "d")], "frame_id long, status int, superseded_by long, text string")
    vectors = spark.createDataFrame([(i, [1.0]) for i in range(4)], "frame_id long, embedding array<double>")
    assert s.commit({"frames": frames, "vectors": vectors}) == 0
    (tmp_path / "store" / "parts-x").mkdir()  # of a commit that broke off
    assert s.current() == 0 and s.compact() == 1 and s.sweep() == 1
    assert {r.frame_id for r in s.read("frames").collect()} == {r.frame_id for r in s.read("vectors").collect()} == {0, 3}
    s.commit({"frames": frames})
    assert s.generations() == [1, 2]


def test_facts_against_a_model(spark):
    rnd, rows, model = random.Random(2), [], {}
    for seq in range(300):
        key = (f"e{rnd.randrange(6)}", f"a{rnd.randrange(3)}")
        if rnd.random() < 0.25:
            model.pop(key, None)
            rows.append((seq, "remove", *key, None, seq, seq, False))
        else:
            model[key] = (model[key][0] + 1 if key in model else 1, f"v{seq}")
            rows.append((seq, "upsert", *key, f"v{seq}", seq, seq, False))
    log = spark.createDataFrame(rows, "seq long, op string, entity string, attribute string, value string, id long, ts_ms long, pinned boolean").repartition(3)
    assert {(r.entity, r.attribute): (r.version, r.value) for r in facts.latest(log).collect()} == model
    pinned = facts.set_pinned(facts.latest(log), [facts.latest(log).first().id])
    with pytest.raises(ValueError, match="pinned"):
        facts.remove(log, pinned, [r.id for r in pinned.collect()], 999, 0)


def test_file_diff_and_line_windows(spark):
    assert list(chunks.line_windows([3, 3, 3, 3], 6, 3)) == [(0, 1, 6), (1, 2, 6), (2, 3, 6)]
    assert list(chunks.line_windows([9, 0], 4, 2)) == [(0, 0, 9), (1, 1, 1)]
    files = spark.createDataFrame([("a.cpp", "class Foo {\n};\nint x;"), ("b.h", "// c\nvoid run(int a)\n"), ("c.h", "\n \n")], "relative_path string, text string")
    got = {r.relative_path: r for r in chunks.chunk_lines(files).collect()}
    assert got["a.cpp"].symbol == "Foo" and got["b.h"].symbol == "run" and "c.h" not in got and len(got["a.cpp"].chunk_id) == 16


def test_streams(spark, tmp_path):
    rows = [(0, "put", 1, None, 0, "a"), (2, "delete", 1, None, 0, None), (1, "put", 2, None, 0, "b"), (3, "supersede", 2, 1, 0, None)]
    spark.createDataFrame(rows, LOG).write.parquet(f"{tmp_path}/in")
    q = streams.fold_stream(streams.read_folder(spark, f"{tmp_path}/in", LOG)).writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.frame_id, r.status, r.superseded_by) for r in spark.table("folded").collect()} == {(1, 1, None), (2, 0, 1)}
    s = store.FrameStore(spark, f"file://{tmp_path}/store")
    for n, text in enumerate(["int a();\n", "int a();\n", "int b();\n"]):
        spark.createDataFrame([("x.cpp", text), (f"y{n}.cpp", "int c();\n")], "relative_path string, text string").coalesce(1).write.parquet(f"{tmp_path}/files/{n}")
    files = spark.readStream.schema("relative_path string, text string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/files")
    streams.ingest_stream(files, s, checkpoint=f"{tmp_path}/check").awaitTermination()
    assert sorted(r.text for r in s.read("chunks").collect()) == ["int a();", "int b();", "int c();", "int c();", "int c();"]
    assert sorted(r.text for r in streams.indexed(s).collect()) == ["int b();", "int c();", "int c();", "int c();"]
    assert sorted(r.relative_path for r in streams.indexed_files(s).collect()) == ["x.cpp", "y0.cpp", "y1.cpp", "y2.cpp"]
    done = streams.throughput(s.read("index_status")).first()
    assert (done.files, done.unchanged, done.chunks, done.batches) == (5, 1, 5, 3) and done.chunks_per_second > 0


def test_engine_remembers_and_keeps_facts(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/engine")
    new = spark.createDataFrame([(1, 5, "one two three four", {"labels": "a,b"}), (0, 4, "zero", {})], "ord long, ts_ms long, text string, metadata map<string,string>")
    e.remember(new, target=3, overlap=1, session="s1")
    frames = sorted(e.store.read("frames").collect(), key=lambda r: r.frame_id)
    assert [(r.frame_id, r.text) for r in frames] == [(0, "zero"), (1, "one two three"), (2, "three four")] and frames[1].metadata["session"] == "s1" and frames[1].labels == ["a", "b"]
    e.remember_handoff("carry on", 9, "p", ["x", "y"])
    assert e.latest_handoff("p").first().text == "carry on" and e.latest_handoff("q").count() == 0
    a = e.add_fact("user:1", "city", "Rome", {"k": "1", "j": "0"})
    b = e.update_fact(a, "Oslo", {"k": "2"})
    assert [(r.value, r.version, r.metadata) for r in e.search_facts("user:").collect()] == [("Oslo", 2, {"k": "2", "j": "0"})]
    assert [r.id for r in e.fact_history(b).collect()] == [b, a] and e.get_fact(a).first().value == "Rome"
    with pytest.raises(ValueError, match="current"):
        e.update_fact(a, "Paris")
    e.pin_fact(b)
    assert e.pin_fact(b) == b
    with pytest.raises(ValueError, match="pinned"):
        e.delete_fact(b)
    e.pin_fact(b, False)
    assert e.delete_fact(b) and not e.delete_fact(b) and e.facts().count() == 0
    e.optimize_surrogates()
    assert e.store.read("surrogates").count() == 4 and e.store.read("frames").count() == 4
    docs = spark.createDataFrame([(1, '{"blueprint": "/A", "asset_name": "A"}')], "doc_id long, json string")
    e.write_graphs(docs)
    assert e.read_graph(e.store.read("graphs"), "A").count() == 1
    with pytest.raises(ValueError, match="blueprint"):
        e.write_graphs(spark.createDataFrame([(2, "{}")], "doc_id long, json string"))


def test_histories_are_followed_to_the_end_whatever_the_depth(spark):
    chain = [(i, i - 1 if i > 1 else None) for i in range(1, 1301)]
    others = [(2000, 2001), (2001, 2002), (2002, 2000), (3000, 3001), (4000, None)]  # a cycle, a missing revision, a single one
    revisions = spark.createDataFrame(chain + others, "id long, supersedes long")
    assert [(r.id, r.step) for r in facts.history(revisions, 1300).collect()] == [(1300 - k, k) for k in range(1300)]
    assert [r.id for r in facts.history(revisions, 2001).collect()] == [2001, 2002, 2000]
    assert facts.history(revisions, 9).count() == 9 and facts.history(revisions, 9999).count() == 0
    got = {(r.head, r.id, r.step) for r in facts.histories(revisions).collect()}
    assert got == {(1300, 1300 - k, k) for k in range(1300)} | {(3000, 3000, 0), (4000, 4000, 0)}


def test_invalid_mutations_are_named_and_left_out(spark, tmp_path):
    rows = [(0, "delete", 1, None, 0, None), *[(1 + k, "put", k, None, k, f"t{k}") for k in range(8)], (20, "supersede", 0, 2, 0, None), (21, "supersede", 1, 2, 0, None), (22, "supersede", 0, 3, 0, None), (23, "supersede", 0, 2, 0, None)]
    rows += [(30, "supersede", 4, 5, 0, None), (31, "supersede", 5, 6, 0, None), (32, "supersede", 6, 4, 0, None), (40, "supersede", 9, 7, 0, None), (41, "delete", 7, None, 0, None)]
    log = spark.createDataFrame(rows, LOG).repartition(3)
    assert sorted((r.seq, r.error) for r in store.mutation_errors(log).collect()) == [(0, "unknown frame"), (21, "conflicting link"), (22, "conflicting link"), (32, "cycle"), (40, "unknown frame")]
    got = {r.frame_id: (r.status, r.supersedes, r.superseded_by) for r in store.fold_mutations(log).collect()}
    assert got == {0: (0, None, 2), 1: (0, None, None), 2: (0, 0, None), 3: (0, None, None), 4: (0, None, 5), 5: (0, 4, 6), 6: (0, 5, None), 7: (1, None, None)}
    s = store.FrameStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError, match="mutation 0: unknown frame"):
        s.apply(log)
    assert s.current() is None
    bad = [0, 21, 22, 32, 40]
    good = log.filter(~F.col("seq").isin(bad))
    assert s.apply(good) == 0 and s.read("frames").count() == 8


def test_chains_of_any_length_and_cycles(spark):
    links = [(i, i + 1) for i in range(1500)] + [(2000, 2001), (3000, 3001), (3001, 3002), (3002, 3001), (4000, 2001)]
    table = spark.createDataFrame(links, "old long, new long")
    assert {(r.root, r.tip, r.hops) for r in store.supersede_tips(table).collect()} == {(0, 1500, 1500), (2000, 2001, 1), (4000, 2001, 1)}
    assert {(r.node, r.cycle) for r in store.supersede_cycles(table).collect()} == {(3000, 3001), (3001, 3001), (3002, 3001)}
    assert {(r.tip, r.root) for r in store.surrogate_map(table).collect()} == {(1500, 0), (2001, 2000)}
    assert store.supersede_tips(table.limit(0)).count() == store.supersede_cycles(table.limit(0)).count() == 0


def test_frames_are_appended_without_loss(spark):
    """Over 8 MB of text and an existing table: adaptive execution merges partitions of different sizes on the way."""
    before = spark.createDataFrame([(k, 0, "x") for k in range(7)], "frame_id long, ts_ms long, text string")
    before = before.selectExpr("frame_id", "ts_ms", "text", "'' as sha256", "0 as status", "'' as kind", "map('a', 'b') as metadata", "array('a') as labels", "0L as supersedes", "0L as superseded_by")
    new = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("doc_id as ord", "doc_id as ts_ms", "concat(text, repeat(cast(doc_id as string), 200)) as text", "map('labels', lang) as metadata")
    got = store.append_frames(before, new).select("frame_id", "ts_ms").orderBy("frame_id").collect()
    ids = sorted(r.ord for r in new.select("ord").collect())
    assert [r.frame_id for r in got] == list(range(len(ids) + 7)) and [r.ts_ms for r in got[7:]] == ids


def test_writers_stages_and_reports(spark, tmp_path):
    a, b = (store.FrameStore(spark, f"file://{tmp_path}/w") for _ in range(2))
    rows = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "frame_id long, text string")
    a.commit({"frames": rows(0, 1)})
    last = b.current()
    a.commit(append={"frames": rows(2)})
    with pytest.raises(store.Conflict):
        b.commit(append={"frames": rows(9)}, expect=last)
    assert sorted(r.frame_id for r in b.read("frames").collect()) == [0, 1, 2]
    b.stage({}, {"frames": rows(3)})
    assert b.read("frames").count() == 3 and b.read("frames", staged=True).count() == 4
    b.rollback()
    b.stage({"other": rows(5)})
    b.commit()
    assert {t: len(p) for t, p in a.tables().items()} == {"frames": 2, "other": 1} and a.read("frames").count() == 3 and a.sweep() == 0
    frames = rows(0, 1).selectExpr("*", "if(frame_id = 0, sha2(text, 256), 'bad') as sha256", "0 as status", "cast(null as long) as superseded_by")
    a.commit({"frames": frames})
    found = {r["table"]: (r.parts, r["rows"], r.detail) for r in a.report().collect()}
    assert found["other"] == (1, 1, None) and found["frames"][:2] == (1, 2) and '"damaged": 1' in found["frames"][2]


def test_overlay_shows_pending_rows(spark):
    frames = store.fold_mutations(spark.createDataFrame([(k, "put", k, None, k, f"t{k}") for k in range(3)] + [(5, "delete", 1, None, 0, None), (6, "supersede", 0, 2, 0, None)], LOG))
    log = spark.createDataFrame([(5, "delete", 1, None, 0, None), (7, "put", 3, None, 3, "t3"), (8, "supersede", 2, 3, 0, None), (9, "delete", 0, None, 0, None)], LOG)
    assert [r.seq for r in store.pending(log, 6).orderBy("seq").collect()] == [7, 8, 9]
    got = {r.frame_id: (r.status, r.supersedes, r.superseded_by) for r in store.overlay(frames, log, 6).collect()}
    assert got == {0: (1, None, 2), 1: (1, None, None), 2: (0, 0, 3), 3: (0, 2, None)}


def test_engine_looks_up_embeds_stages_and_rebuilds(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/engine", internal=("OWN1",))
    e.remember(spark.createDataFrame([(k, k, f"text {k}", {}) for k in range(4)] + [(9, 9, "OWN1 inner", {})], "ord long, ts_ms long, text string, metadata map<string,string>"))
    assert {r.frame_id: r.text for r in e.contents([1, 3, 4, 77]).collect()} == {1: "text 1", 3: "text 3"} and "text" not in e.frames([1], payload=False).columns
    vectors = lambda *rows: spark.createDataFrame(list(rows), "frame_id long, embedding array<double>")
    e.put_embeddings(vectors((0, [1.0, 0.0]), (1, [0.0, 1.0])))
    e.put_embeddings(vectors((1, [0.5, 0.5])))
    for bad in (vectors((0, [1.0])), vectors((0, [1.0, float("nan")])), vectors((50, [1.0, 1.0]))):
        with pytest.raises(ValueError, match="frame|vector"):
            e.put_embeddings(bad)
    assert {r.frame_id: r.embedding for r in e.vectors().collect()} == {0: [1.0, 0.0], 1: [0.5, 0.5]}
    e.add_fact("a", "b", "1")
    e.add_fact("a", "c", "2", commit=False)
    e.add_fact("a", "d", "3", commit=False)
    assert e.facts().count() == 1 and e.facts(staged=True).count() == 3
    e.rollback()
    e.add_fact("a", "c", "4", commit=False)
    e.flush()
    assert e.flush() is None and {(r.attribute, r.value) for r in e.facts().collect()} == {("b", "1"), ("c", "4")} and len(e.store.tables()["fact_log"]) == 2
    assert e.forget("a", "b") and not e.forget("a", "b")
    files = spark.createDataFrame([("x.cpp", "int a();\n")], "relative_path string, text string")
    files.write.parquet(f"{tmp_path}/files")
    e.start_index(spark.readStream.schema("relative_path string, text string").parquet(f"{tmp_path}/files")).awaitTermination()
    assert e.index_status().first().chunks == 1
    made = e.rebuild()
    assert made["facts"].count() == 1 and made["live"].count() == 5 and made["vectors"].count() == 2 and made["surrogate_map"].count() == 0
    assert {r["table"] for r in e.report().collect()} == {"frames", "embeddings", "fact_log", "files", "chunks", "index_status"}


def test_byte_pair_chunks_and_checks(spark, tmp_path):
    path = tmp_path / "bytes.vocab"
    path.write_text("\n".join(f"{base64.b64encode(bytes([b])).decode()} {b}" for b in range(256)) + "\nbroken line\n")
    frames = spark.createDataFrame([(1, "abcdefghij"), (2, "é"), (3, ""), (4, None)], "frame_id long, text string")
    got = {(r.frame_id, r.chunk): (r.start, r.end, r.text) for r in chunks.chunk_bpe(frames, str(path), 4, 1).collect()}
    assert got == {(1, 0): (0, 4, "abcd"), (1, 1): (3, 7, "defg"), (1, 2): (6, 10, "ghij"), (2, 0): (0, 2, "é")}
    assert streams.checked_name("a_B-1") == "a_B-1" and streams.checked_range("n", 3, 1, 3) == 3
    for bad in ("a/b", "ü", "a b"):
        with pytest.raises(ValueError, match="no name"):
            streams.checked_name(bad)
    for bad in (0, 4, True, 1.5):
        with pytest.raises(ValueError, match="whole number"):
            streams.checked_range("n", bad, 1, 3)


def test_marginal_relevance_against_all_pairs():
    rnd = random.Random(6)
    for _ in range(200):
        n = rnd.randrange(1, 14)
        bags = [{rnd.randrange(9) for _ in range(rnd.randrange(6))} for _ in range(n)]
        scores = [rnd.choice([0.0, 1.0, 2.5, rnd.random() * 5]) for _ in range(n)]
        chosen = []
        while len(chosen) < min(n, 8):
            worth = {i: scores[i] * (1 - max([len(bags[i] & bags[j]) / len(bags[i] | bags[j]) if bags[i] & bags[j] else 0.0 for j in chosen], default=0.0)) for i in range(n) if i not in chosen}
            chosen.append(max(worth, key=lambda i: (worth[i], scores[i], -i)))
        assert maintain._pick(scores, bags, 8) == chosen
