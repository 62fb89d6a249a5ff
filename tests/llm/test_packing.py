import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.queries import QUERIES
from tidemark.llm.tokens import Encoder, default_vocabulary

TEXTS = [None, "", " ", "Don't STOP\tnow\r\nplease", "café café naïve 　wide", "a" * 3000, "<|endoftext|> inside it", "word " * 9000, "x y\x0bz\x85q\xa0r", "word " * 9000, "🙂 emoji 123,456.78", "tail\n\n\n"]


def ids(text):
    return [*Tokenizer.from_file(default_vocabulary()).encode(text or "", add_special_tokens=False).ids, 2]


def test_remembered_pieces_give_the_library_s_ids():
    signs = "".join(map(chr, range(33, 700))) + "́ßſKİΣς"
    rnd = random.Random(8)
    odd = [" ".join("".join(rnd.choices(signs if k % 2 else "abcde.,'AÉß12!-", k=rnd.randrange(1, 9))) for _ in range(400)) for k in range(30)]
    odd += [c.join("abc Def") for c in map(chr, [*range(1, 33), 0x85, 0xA0, 0x2028, 0x3000, 0x301, 0xFFFD])]
    plain = Tokenizer.from_file(default_vocabulary())
    for most in (3, 1000, 10**6):
        encoder = Encoder(default_vocabulary(), most=most)
        for t in [*TEXTS, *odd] * 2:
            assert encoder.encode(t or "").tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_round_trip_and_no_padding(spark, tmp_path):
    rows = [(i, t, i) for i, t in enumerate(TEXTS * 5)]
    spark.createDataFrame(rows, "doc_id long, text string, ids int").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_curve_packing"](spark, str(tmp_path)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t, _ in rows:
        whole, at = ids(t), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole)
            assert r.ids_crc32 == zlib.crc32(np.array(whole[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(whole)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096 and at & (at - 1) == 0


def test_payload_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "same text"), (None, "same text"), (3, None)], "doc_id long, text string")
    got = packing.pack(docs, payload=True).collect()
    assert sum(r.length for r in got) == sum(len(ids(t)) for t in ("same text", "same text", None))
    assert all(len(r.ids) == 4 * r.length for r in got)
    assert packing.pack(docs.limit(0)).count() == 0


def test_hilbert_neighbours_touch():
    side = np.arange(8) << 13
    cells = np.array([(a, b, c) for a in side for b in side for c in side])
    order = cells[np.argsort(packing.hilbert_key(cells))] >> 13
    assert len(set(packing.hilbert_key(cells).tolist())) == 512
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_on_the_curve_share_sequences(spark):
    """Documents of two kinds, laid out by turns, hardly ever meet in a sequence."""
    kinds = ["the river runs down to the sea and the boats go out", "0x1f 42 97 3.14 17 % { } [ ] ; = + 88 12 404"]
    rows = [(k, " ".join(kinds[k % 2].split()[j % 11] for j in range(k, k + 150))) for k in range(160)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), size=512).collect()
    held = {}
    for r in pieces:
        held.setdefault(r.sequence_id, set()).add(r.doc_id % 2)
    mixed = sum(len(x) > 1 for x in held.values())
    assert len(held) > 40 and mixed <= 0.15 * len(held)
