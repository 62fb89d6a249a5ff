"""Language identification in two steps: the family first, then linear support vector machines, one for each pair of
languages, within it.

Features are hashed character pairs and triples of the letters of the whole text.  The models learn from a sample of
labelled rows whose size is bounded by ``per_language`` (their features, not their texts, come to the driver); all
rows are classified by the executors.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh

DIM = 1 << 14
UNKNOWN = "und"
_BLOCK = 1 << 20

#: Families of ISO 639-1 codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg mk sr hr bs sl sk cs pl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi mr ne bn gu pa or as ur",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "celtic": "ga gd cy br",
}


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes.split()), f"other:{lang}")


_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Indices and values (length one) of a text's hashed n-grams; None if it has no letters."""
    counts, letters, text = np.zeros(DIM), 0, text or ""
    for k in range(0, len(text), _BLOCK):
        codes = np.frombuffer(f" {text[k : k + _BLOCK].lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        alpha = _LETTER[np.minimum(codes, (1 << 16) - 1)]
        high = np.flatnonzero(codes >= 1 << 16)
        if len(high):
            kinds, of = np.unique(codes[high], return_inverse=True)
            alpha[high] = np.array([chr(c).isalpha() for c in kinds.tolist()])[of]
        letters += int(alpha.sum())
        codes = np.where(alpha, codes, 0)
        codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])].astype(np.uint32)
        for n in (2, 3):
            if len(codes) >= n:
                h = np.full(len(codes) - n + 1, n, np.uint32)
                for j in range(n):
                    h = (h ^ codes[j : len(codes) - n + 1 + j]) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                counts += np.bincount(h % np.uint32(DIM), minlength=DIM)
    if not letters:
        return None
    at = np.flatnonzero(counts)
    value = np.sqrt(counts[at])
    return at.astype(np.int32), (value / np.linalg.norm(value)).astype(np.float32)


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, epochs: int = 12, decay: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine, by averaged stochastic subgradients."""
    w, total, scale, steps, rng = np.zeros(DIM + 1), np.zeros(DIM + 1), 1.0, 0, np.random.default_rng(seed)
    share = {s: 0.5 / max(1, int((sign == s).sum())) * len(sign) for s in (-1, 1)}  # both sides weigh the same
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            steps += 1
            rate = 1 / (decay * (steps + 1 / decay))
            at, value = rows[i]
            scale *= 1 - rate * decay
            if sign[i] * (scale * float(w[at] @ value) + scale * w[DIM]) < 1:
                w[at] += rate * share[sign[i]] * sign[i] * value / scale
                w[DIM] += rate * share[sign[i]] * sign[i] * 0.1 / scale
        total += scale * w
    return total / epochs


class Model:
    """``languages`` by family, the families' machines (one against the rest) and one machine for each pair."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(family(lang), []).append(lang)
        of, lang_of = np.array([family(x) for x in langs]), np.array(langs)
        names = sorted(self.families)
        self.top = [(f, _svm(rows, np.where(of == f, 1, -1))) for f in names] if len(names) > 1 else [(f, np.zeros(DIM + 1)) for f in names]
        self.pairs: dict[tuple[str, str], np.ndarray] = {}
        for within in self.families.values():
            for a, b in combinations(within, 2):
                pick = np.flatnonzero((lang_of == a) | (lang_of == b))
                self.pairs[a, b] = _svm([rows[i] for i in pick], np.where(lang_of[pick] == a, 1, -1))

    def predict(self, text: str | None) -> tuple[str, float]:
        got = features(text)
        if got is None or not self.top:
            return UNKNOWN, 0.0
        at, value = got
        margin = lambda w: float(w[at] @ value + w[DIM])
        tops = np.array([margin(w) for _, w in self.top])
        best = int(tops.argmax())
        odds = np.exp(2 * (tops - tops.max()))
        score, langs = float(odds[best] / odds.sum()), self.families[self.top[best][0]]
        votes, sums, sure = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0), {}
        for a, b in combinations(langs, 2):
            m = margin(self.pairs[a, b])
            votes[a if m >= 0 else b] += 1
            sums[a], sums[b], sure[a, b] = sums[a] + m, sums[b] - m, 1 / (1 + np.exp(-2 * abs(m)))
        lang = min(langs, key=lambda x: (-votes[x], -sums[x], x))
        mine = [p for pair, p in sure.items() if lang in pair]
        return lang, min(1.0, max(0.0, score * (float(np.mean(mine)) if mine else 1.0)))


def held_out(doc_id: Column) -> Column:
    """True if crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600) -> Model:
    """Learns from ``per_language`` rows of each label (all, if fewer), those whose ids have the smallest hashes.

    Held-out rows and null ids and labels are left out; repeated rows count each but never exceed that bound; an empty
    table gives a model that knows nothing.  What the driver holds is bounded by ``per_language`` and the labels.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], [])
    # far fewer than per_language of them are below 2 * per_language / n only by a chance that can be left aside
    bound = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2 * per_language / n + 1e-15)))])
    place = F.xxhash64(F.lit(11), "id") / F.lit(2.0**64) + F.lit(0.5)
    near = rows.withColumn("place", place).filter(F.col("place") <= bound[F.col("lang")])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", F.xxhash64("text")))
    picked = near.withColumn("n", first).filter(F.col("n") <= per_language).select("text", "lang")

    def run(batches):
        for batch in batches:
            got = [(features(t.as_py()), lang.as_py()) for t, lang in zip(batch.column(0), batch.column(1), strict=True)]
            got = [(x[0].tobytes(), x[1].tobytes(), lang) for x, lang in got if x]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.binary(), pa.binary(), pa.string()), strict=True)], names=["at", "value", "lang"])

    got = sorted((r["lang"], bytes(r["at"]), bytes(r["value"])) for r in picked.mapInArrow(run, "at binary, value binary, lang string").collect())
    return Model([(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for _, a, v in got], [lang for lang, _, _ in got])


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The input's columns and two of the given names: the language, and how sure that is (0 to 1).

    Input columns of these two names are replaced.  Texts without letters, empty and null ones get ``und`` and 0, as
    does everything if nothing could be learned; rows are independent of each other; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of the languages' pairs
    kept = [f for f in docs.schema.fields if f.name.lower() not in names]
    at = [f.name for f in kept].index(text_col)

    def run(batches):
        own = shared.value
        for batch in batches:
            got = [own.predict(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*batch.schema.names, *names])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's rows for whose text a language is found; columns of any names pass through."""
    names = tuple(fresh(docs, "lang_pred", "lang_score"))
    return identify(docs, model, text_col, names).filter(F.col(names[0]) != UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])
