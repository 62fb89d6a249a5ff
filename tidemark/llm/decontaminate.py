"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF vectors over the benchmark's words.  A randomised SVD, whose sums over all
passages are made by the executors, gives a latent space of ``rank`` dimensions; each benchmark item is compared by
cosine with every window of its own length.  Windows that come near are candidates, and so is, whatever its cosine,
each place where a few successive words of an item occur (all words of shorter items), so that no copy of an item is
lost among other benchmark words.  Candidates count as leaks if the longest common subsequence of words says so, alone
or together with the item's answer (its last sentence).

Words are encoded once, as numbers of benchmark words, in a written table that all later passes read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, fresh, width

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?。！？\n]+")
_BLOCK = 16  # words; windows begin at multiples of it
_SIZES = (3, 5)  # blocks of a window, the smallest that holds the item wherever it begins; longer items have their own
_SLICE = 128  # features whose sums travel together
_CHUNK = 1 << 13  # words whose vectors are made at a time; they fit a core's cache
_ANCHOR = 4  # successive words of an item that make a place a candidate
_RANK = 96  # dimensions of the latent space at least; a larger block of items has one for each eight
_SEEN = 20  # bits of an anchor's key that are looked up first


@dataclass(frozen=True)
class Limits:
    """When a window is a candidate and when a candidate is a leak."""

    cosine: float = 0.45
    lcs: float = 0.8
    lcs_with_answer: float = 0.6
    answer: float = 0.75
    least_words: int = 5  # shorter items must occur word for word


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def places_of(item: list[int]) -> dict[int, int]:
    """Where each word of an item stands in it, as bits."""
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    return places


def common_subsequence(item: list[int], region: list[int], places: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit-parallel row updates."""
    get = (places_of(item) if places is None else places).get
    row = full = (1 << len(item)) - 1
    for w in region:
        hit = row & get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


class Items:
    """A block of benchmark items as numbers of their words, with the number of blocks a window for each needs."""

    def __init__(self, rows: list[tuple[object, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words, self.bags, self.answers, self.blocks, self.places, self.answer_places = [], [], [], [], [], [], []
        for key, text in rows:
            words = words_of(text)
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            sentences = [s for s in map(words_of, _SENTENCE.split(text or "")) if s]
            self.ids.append(key)
            self.words.append(ids)
            self.bags.append(np.unique(ids))
            self.answers.append([self.vocabulary[w] for w in sentences[-1]])
            self.places.append(places_of(ids))
            self.answer_places.append(places_of(self.answers[-1]))
            need = -(-(len(ids) + _BLOCK - 1) // _BLOCK)
            self.blocks.append(next((m for m in _SIZES if m >= need), need))


def _encode(docs: DataFrame, id_col: str, text_col: str, items: Items) -> DataFrame:
    """``(id, k1, k2, words)``: the text's words as little-endian 32-bit numbers, -1 for words of no item.

    Whole passages of two blocks are written, the last being filled up with -1, so texts can be laid end to end and no
    passage holds words of two.
    """
    raw = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(1), raw).alias("k1"), F.xxhash64(F.lit(2), raw).alias("k2"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)  # one block of the benchmark

    def run(batches):
        from itertools import repeat

        get = shared.value.get
        for batch in batches:
            out = []
            for x in batch.column(3):
                words = words_of(x.as_py())
                ids = np.full(-(-len(words) // (2 * _BLOCK)) * 2 * _BLOCK, -1, "<i4")
                ids[: len(words)] = np.fromiter(map(get, words, repeat(-1)), "<i4", len(words))
                out.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["id", "k1", "k2", "words"])

    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, k1 long, k2 long, words binary")


def _summed(parts: DataFrame, spark, shape: tuple[int, int]) -> np.ndarray:
    """Adds up ``(slice, sums)`` rows of all tasks, slice by slice as they stream by, and gathers the one total."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(raw.as_py(), float)
                total[k] = total[k] + got if k in total else got
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "sums"])

    out = np.zeros(shape)
    for r in parts.repartition(min(width(spark), -(-shape[0] // _SLICE)), "slice").mapInArrow(run, "slice long, sums binary").collect():
        got = np.frombuffer(r["sums"], float).reshape(-1, shape[1])
        out[r["slice"] * _SLICE : r["slice"] * _SLICE + len(got)] += got
    return out


def _few(encoded: DataFrame) -> DataFrame:
    """The words in no more tasks than a shuffle has partitions: each task sends one set of sums, however large its share."""
    return encoded.select("words").coalesce(max(1, width(encoded.sparkSession)))


def _slices(sums: np.ndarray) -> pa.RecordBatch:
    n = range(0, len(sums), _SLICE)
    return pa.RecordBatch.from_arrays([pa.array([k // _SLICE for k in n], pa.int64()), pa.array([np.ascontiguousarray(sums[k : k + _SLICE]).tobytes() for k in n], pa.binary())], names=["slice", "sums"])


def _runs(batches):
    """The encoded words of many texts end to end, about ``_CHUNK`` at a time, cut at passages."""
    held, n = [], 0
    for batch in batches:
        for raw in batch.column(0):
            words = np.frombuffer(raw.as_py(), "<i4")
            for k in range(0, len(words), _CHUNK):
                held.append(words[k : k + _CHUNK])
                n += len(held[-1])
                if n >= _CHUNK:
                    yield np.concatenate(held)
                    held, n = [], 0
    if held:
        yield np.concatenate(held)


def document_frequency(encoded: DataFrame, n_words: int) -> tuple[np.ndarray, int]:
    """In how many passages of two blocks' words each word occurs, over all documents, and how many passages there are."""

    def run(batches):
        df = np.zeros((n_words + 1, 1))
        for words in _runs(batches):
            at = np.flatnonzero(words >= 0)
            pairs = np.unique((at // (2 * _BLOCK)) * n_words + words[at])
            df[:n_words, 0] += np.bincount(pairs % n_words, minlength=n_words)
            df[n_words] += -(-len(words) // (2 * _BLOCK))
        yield _slices(df)

    total = _summed(_few(encoded).mapInArrow(run, "slice long, sums binary"), encoded.sparkSession, (n_words + 1, 1))[:, 0]
    return total[:n_words], int(total[n_words])


def block_vectors(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``table`` by block of words; words of -1 have none."""
    out = np.zeros((-(-len(words) // _BLOCK), table.shape[1]), np.float32)
    at = np.flatnonzero(words >= 0)
    if len(at):
        block = at // _BLOCK
        first = np.flatnonzero(np.diff(block, prepend=-1))
        out[block[first]] = np.add.reduceat(table[words[at]], first, axis=0)
    return out


def latent_table(encoded: DataFrame, items: Items, idf: np.ndarray, rank: int) -> np.ndarray:
    """What each word adds to a passage's place in the latent space: ``(words, rank)``.

    One pass over all passages (a block each) makes Y = A'(A R) for a random R, A being their TF-IDF matrix; the items
    are passages too, weighted to hold as much as the corpus does.  From Y and R come the leading right singular
    vectors V and values S of A; a passage x lies at x V / S, where all directions vary alike.
    """
    spark, n = encoded.sparkSession, len(idf)
    rank = min(rank, n)
    random = np.random.default_rng(17).standard_normal((n, rank))
    sketch = (random * idf[:, None]).astype(np.float32)
    shared = spark.sparkContext.broadcast((sketch, idf))  # one block of the benchmark

    def project(words: np.ndarray, sums: np.ndarray, table: np.ndarray, idf: np.ndarray) -> None:
        """Adds A'(A R) of a run of blocks, and their squares in the last column."""
        made = block_vectors(words, table)
        at = np.flatnonzero(words >= 0)
        if len(at):
            order = at[np.argsort(words[at], kind="stable")]
            ids = words[order]
            first = np.flatnonzero(np.diff(ids, prepend=-1))
            row = ids[first]
            sums[row, :-1] += idf[row][:, None] * np.add.reduceat(made[order // _BLOCK], first, axis=0)
            sums[row, -1] += idf[row] ** 2 * np.diff(first, append=len(ids))

    def run(batches):
        table, idf = shared.value
        sums = np.zeros((n, rank + 1))
        for words in _runs(batches):
            project(words, sums, table, idf)
        yield _slices(sums)

    corpus = _summed(_few(encoded).mapInArrow(run, "slice long, sums binary"), spark, (n, rank + 1))
    own = np.zeros((n, rank + 1))
    for words in items.words:
        project(np.array(words, "<i4"), own, sketch, idf)
    weight = max(corpus[:, -1].sum() / max(own[:, -1].sum(), 1e-12), 1e-9)
    product = corpus[:, :-1]
    product += weight * own[:, :-1]
    core = random.T @ product
    del own, random, sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values[-1] * 1e-10
    v, s, _ = np.linalg.svd(product @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return (v / np.maximum(s, s[0] * 1e-6) * idf[:, None]).astype(np.float32)


def _segments(texts: list[np.ndarray], overlap: int):
    """Groups of ``(text, first block, blocks, own blocks)`` of about ``_CHUNK`` words; long texts are cut, with an overlap."""
    group, n, most = [], 0, _CHUNK // _BLOCK
    for k, words in enumerate(texts):
        total = len(words) // _BLOCK
        for s in range(0, total, most):
            blocks = min(total - s, most + overlap)
            group.append((k, s, blocks, min(most, total - s)))
            n += blocks
            if n >= most:
                yield group
                group, n = [], 0
    if group:
        yield group


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of each ``n`` successive words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        out = (out + words[j : j + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return out


def _anchors(items: Items) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(words, first bits seen, sorted keys, their items, their places in the item)`` by the number of words."""
    found: dict[int, list] = {}
    for item, words in enumerate(items.words):
        keys = _grams(np.array(words), n := min(_ANCHOR, len(words)))
        found.setdefault(n, []).append((keys, np.full(len(keys), item), np.arange(len(keys))))
    out = []
    for n, parts in sorted(found.items()):
        keys, item, place = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        seen = np.zeros(1 << _SEEN, bool)
        seen[keys >> np.uint64(64 - _SEEN)] = True
        out.append((n, seen, keys[order], item[order], place[order]))
    return out


def _anchored(texts: list[np.ndarray], items: Items, anchors: list):
    """``(text, item, first word, end)`` of windows that hold an anchor, once each.

    Texts are read end to end; an anchor that reaches from one text into the next is only one more candidate.
    """
    if not texts:
        return
    base = np.cumsum([0, *map(len, texts)])
    words, blocks = np.concatenate(texts), np.array(items.blocks)
    for s in range(0, len(words), _CHUNK):
        part, found = words[s : s + _CHUNK + _ANCHOR - 1], []
        for n, seen, keys, item, place in anchors:
            grams = _grams(part, n)[:_CHUNK]
            at = np.flatnonzero(seen[grams >> np.uint64(64 - _SEEN)])
            low = np.searchsorted(keys, grams[at])
            many = np.searchsorted(keys, grams[at], "right") - low
            if not many.sum():
                continue
            entry = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            at = np.repeat(at, many) + s
            text = np.searchsorted(base, at, "right") - 1
            first = np.maximum(at - base[text] - place[entry], 0) // _BLOCK * _BLOCK
            found.append(np.stack([text, item[entry], first]))
        if found:
            text, item, first = np.unique(np.concatenate(found, axis=1), axis=1)
            yield from zip(text.tolist(), item.tolist(), first.tolist(), (first + blocks[item] * _BLOCK).tolist(), strict=True)


def _leaks(encoded: DataFrame, items: Items, table: np.ndarray, limits: Limits) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast((table, items, _anchors(items)))  # one block of the benchmark

    def sizes(items: Items, table: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, float]]:
        out = []
        for m in sorted(set(items.blocks)):
            pick = np.array([k for k, b in enumerate(items.blocks) if b == m])
            vectors = np.stack([table[items.words[k]].sum(axis=0) for k in pick])
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
            out.append((m, pick, np.ascontiguousarray(vectors.T), limits.lcs_with_answer * min(len(items.words[k]) for k in pick)))
        return out

    def candidates(texts: list[np.ndarray], items: Items, kinds: list, table: np.ndarray):
        """``(text, item, cosine, first word, end)`` of each window near an item that holds enough of its words.

        What is counted is the window and a block on either side, as far as the text goes; where only a piece of the text
        is at hand, a block beyond it counts as full.
        """
        own_word = np.zeros(len(table) + 1, bool)  # the last one stands for words of no item
        for group in _segments(texts, max(m for m, *_ in kinds)):
            words = np.concatenate([texts[k][s * _BLOCK : (s + b) * _BLOCK] for k, s, b, _ in group])
            vectors = block_vectors(words, table)
            total = np.vstack([np.zeros((1, table.shape[1])), np.cumsum(vectors, axis=0, dtype=float)])
            held = np.concatenate([[0], np.cumsum((words >= 0).reshape(-1, _BLOCK).sum(axis=1))])
            base = np.cumsum([0, *[b for *_, b, _ in group]])
            for m, pick, side, least in kinds:
                counts = [max(0, min(own, max(1, b - m + 1))) if s + b == len(texts[k]) // _BLOCK else own for k, s, b, own in group]
                of = np.repeat(np.arange(len(group)), counts)
                first = base[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                last = np.minimum(first + m, base[of + 1])
                enough = held[last] - held[first] >= least
                of, first, last = of[enough], first[enough], last[enough]
                window = (total[last] - total[first]).astype(np.float32)
                norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-12)
                near = (window @ side).T
                low, high = np.maximum(first - 1, base[of]), np.minimum(last + 1, base[of + 1])
                cut = np.array([(s > 0, s + b < len(texts[k]) // _BLOCK) for k, s, b, _ in group], bool)[of]
                spare = _BLOCK * ((cut[:, 0] & (first == base[of])).astype(int) + (cut[:, 1] & (last == base[of + 1])))
                close = near >= limits.cosine * norm
                for j in np.flatnonzero(close.any(axis=1)):
                    item = int(pick[j])
                    own_word[items.bags[item]] = True
                    met = np.concatenate([[0], np.cumsum(own_word[words].reshape(-1, _BLOCK).sum(axis=1))])
                    own_word[items.bags[item]] = False
                    for i in np.flatnonzero(close[j] & (met[high] - met[low] + spare >= limits.lcs_with_answer * len(items.words[item]))):
                        k, s, *_ = group[of[i]]
                        at = int(first[i] - base[of[i]] + s) * _BLOCK
                        yield k, item, float(near[j, i] / norm[i]), at, at + int(last[i] - first[i]) * _BLOCK

    def run(batches):
        table, items, anchors = shared.value
        kinds = sizes(items, table)
        item_type = pa.array(items.ids).type
        names = ["id", "k1", "k2", "item", "cosine", "lcs", "answer", "start", "exact"]
        types = [item_type, pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
        for batch in batches:
            texts = [np.frombuffer(raw.as_py(), "<i4") for raw in batch.column(3)]
            best: dict[tuple[int, int], tuple] = {}
            for k, item, cosine, start, end in candidates(texts, items, kinds, table):
                _judge(best, items, k, item, cosine, texts[k], start, end, limits)
            for k, item, start, end in _anchored(texts, items, anchors):
                _judge(best, items, k, item, None, texts[k], start, end, limits, table)
            if best:
                keys = sorted(best)
                found = [(items.ids[item], best[k, item][1], best[k, item][0], *best[k, item][2:]) for k, item in keys]
                rows = pa.array([k for k, _ in keys])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in range(3)], *[pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]], names=names)

    kind = {"int64": "long", "int32": "int"}.get(str(pa.array(items.ids).type), "string")
    return encoded.mapInArrow(run, f"id {encoded.dtypes[0][1]}, k1 long, k2 long, item {kind}, cosine double, lcs double, answer double, start long, exact boolean")


def _judge(best: dict[tuple[int, int], tuple], items: Items, text: int, item: int, cosine: float | None, words: np.ndarray, start: int, end: int, limits: Limits, table: np.ndarray | None = None) -> None:
    """Verifies a candidate window and keeps the item's best one of the text; a cosine not given is that by ``table``."""
    own, key = items.words[item], (text, item)
    if key in best and best[key][0] == 1.0 and best[key][4]:
        return
    region = words[max(0, start - _BLOCK) : end + _BLOCK]
    if cosine is None and np.isin(region, items.bags[item]).sum() < limits.lcs_with_answer * len(own):
        return  # no subsequence can be long enough; windows with a cosine were counted before
    known = region[region >= 0].tolist()
    lcs = common_subsequence(own, known, items.places[item]) / len(own)
    if lcs < limits.lcs_with_answer:
        return
    region = region.tolist()
    exact = lcs == 1.0 and any(region[k : k + len(own)] == own for k in range(len(region) - len(own) + 1))
    answer = common_subsequence(items.answers[item], known, items.answer_places[item]) / len(items.answers[item])
    leak = exact if len(own) < limits.least_words else lcs >= limits.lcs or lcs >= limits.lcs_with_answer and answer >= limits.answer
    if leak and cosine is None:
        at = words[start:end]
        window, side = table[at[at >= 0]].sum(axis=0), table[own].sum(axis=0)
        cosine = float(window @ side / max(np.linalg.norm(window) * np.linalg.norm(side), 1e-12))
    if leak and (key not in best or (lcs, exact, cosine) > (best[key][0], best[key][4], best[key][1])):
        best[key] = (lcs, cosine, answer, start, exact)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int | None = None, limits: Limits | None = None, items_at_once: int = 2048) -> DataFrame:
    """``(id, k1, k2, item, cosine, lcs, answer, start, exact)``: the leaks of each row, one for each item that it holds.

    k1 and k2 are hashes of the row's text.  Texts are searched end to end, whatever their length.  Null texts have no words; items without words (null ones too) leak
    nowhere; repeated rows and items are judged each; further columns are ignored; empty tables give no rows.  The
    benchmark is taken in blocks of ``items_at_once``, so what is broadcast is bounded whatever its size.  The latent space has
    ``rank`` dimensions; if none are given, their number grows with the items of a block.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "decontaminate")
    limits = limits or Limits()
    source = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).cast("string").alias("t"))
    total = source.count()
    found = None
    for k in range(parts := -(-total // items_at_once)):
        part = source if parts == 1 else source.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        items = Items(sorted(((r["i"], r["t"]) for r in part.collect() if r["i"] is not None), key=lambda x: (str(x[0]).zfill(20), x[1] or "")))
        if not items.ids:
            continue
        encoded = ws.table(_encode(docs, id_col, text_col, items), f"words-{k}", compression="zstd")
        df, passages = document_frequency(encoded, len(items.vocabulary))
        idf = np.log((1 + passages) / (1 + df)) + 0.05
        leaks = ws.table(_leaks(encoded, items, latent_table(encoded, items, idf, rank or max(_RANK, len(items.ids) // 8)), limits), f"leaks-{k}")
        ws.drop(f"words-{k}")
        found = leaks if found is None else found.union(leaks)
    if found is None:
        kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
        return spark.createDataFrame([], f"id {kinds[0]}, k1 long, k2 long, item {kinds[1]}, cosine double, lcs double, answer double, start long, exact boolean")
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The input's rows whose text holds no item.

    Null and empty texts hold none; repeated rows are judged alike; columns of any names pass through; empty tables
    give the input.
    """
    k1, k2 = fresh(docs, "k1", "k2")
    leaks = find_leaks(docs.select(F.lit(0).alias("row"), F.col(f"`{text_col}`").alias("text")), benchmark, "row", "text", **options).select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct()
    raw = F.col(f"`{text_col}`").cast("binary")
    keyed = docs.withColumns({k1: F.xxhash64(F.lit(1), raw), k2: F.xxhash64(F.lit(2), raw)})
    return keyed.join(leaks, [k1, k2], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
