import base64
import gzip
import hashlib
import io

import pytest

from tidemark.llm import warc
from tidemark.llm.queries import QUERIES


def brute(rows, least=0):
    out = []
    for i, html in rows:
        p = (html or "").encode()
        same = [k for k, h in rows if (h or "").encode() == p and k is not None]
        first = max(same, default=i) if len(p) >= least else i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), *(("response", None) if first == i else ("revisit", first))))
    return sorted(out)


ROWS = [(0, "<p>a</p>"), (1, None), (2, ""), (3, "<p>a</p>"), (4, "é" * 3_000_000), (9, "<p>a</p>"), (5, "WARC/1.1\r\n\r\nWARC-Type: response"), (6, "é" * 3_000_000), (7, "\n\n")]


def test_query_against_brute_force(spark, tmp_path):
    spark.createDataFrame([(i, f"http://x/{i}\r\nA: b", h, "q") for i, h in ROWS], "page_id long, url string, html string, digest string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op5_warc_round_trip"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(ROWS)


def test_payloads_come_back_in_bounded_chunks(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in ROWS], "page_id long, url string, html string")
    got = warc.round_trip(pages, least=20).collect()
    assert {r.record_type for r in got if r.record_key == "0"} == {"response"}
    whole = {}
    for r in sorted(got, key=lambda r: r.chunk):
        assert len(r.data) <= warc.CHUNK
        whole[r.record_key] = whole.get(r.record_key, b"") + r.data
    assert whole["4"] == b"" and whole["6"] == ("é" * 3_000_000).encode() and whole["5"] == ROWS[6][1].encode()


def test_empty_table_repeated_rows_and_null_keys(spark):
    pages = spark.createDataFrame([(None, None, "x"), (1, "u", "x"), (1, "u", "x")], "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert sorted((r.record_key or "", r.record_type, r.refers_to) for r in got) == [("", "revisit", "1"), ("1", "response", None), ("1", "response", None)]
    assert warc.round_trip(pages.limit(0)).count() == 0
    many = spark.createDataFrame([(k % 7 or None, "u", f"x{k % 3}") for k in range(60)], "page_id long, url string, html string").repartition(4)
    got = warc.round_trip(many).collect()
    assert len({r.record_id for r in got}) == 60


def test_damage_in_an_archive_is_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "some payload of a page")], "page_id long, url string, html string")
    (row,) = warc.write_archives(warc.plan_records(pages.coalesce(1), "page_id", "url", "html"), f"file://{tmp_path}", level=0).filter("records > 0").collect()
    path = row.file.removeprefix("file://")
    raw = gzip.decompress(open(path, "rb").read())
    open(path, "wb").write(gzip.compress(raw.replace(b"some payload", b"other payload"[:12])))
    with pytest.raises(Exception, match="not what its digest says"):
        warc.read_chunks(spark, spark.createDataFrame([(row.file,)], "file string")).collect()


def test_plain_and_foreign_archives():
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    for raw in (record * 3, gzip.compress(record) * 3, gzip.compress(record * 3)):
        got = list(warc.read_records(io.BytesIO(raw), chunk=3))
        assert [x[2] for x in got] == [b"bod", b"y"] * 3 and [x[5] for x in got] == [False, True] * 3


def test_each_chunk_carries_the_digest_so_far():
    body = b"abcdefgh"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    got = list(warc.read_records(io.BytesIO(record), chunk=3))
    assert [x[4] for x in got] == [base64.b32encode(hashlib.sha1(body[:n]).digest()).decode() for n in (3, 6, 8)]
