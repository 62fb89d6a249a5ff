"""SimHash near-duplicates: byte-position inverted index, count filter, exact verification, components.

A 64-bit fingerprint has eight positional bytes; two fingerprints at ``max_bits`` (1 or 2) or fewer differing bits
share at least ``8 - max_bits`` of them.  The posting list of one positional byte would hold a 256th of all rows, so
lists are split by three further positional bytes: postings are filed under four bytes at once, at the 14 choices of
positions of a Steiner system, in which any three positions lie in exactly one choice.  Two fingerprints that share
six bytes then meet in exactly 3 lists, with seven in 7, with five or fewer in 1 at most.  Meetings are tallied for
each pair, pairs below the guaranteed 3 or 7 are dropped, and the others are verified bit by bit.

Lists of over ``light`` distinct fingerprints emit no pairs.  Their fingerprints go through an exact way that is
linear in their number: two fingerprints differ in at most two bits if and only if flipping at most one bit of each
gives a common value, and such a value has at most 65 fingerprints around it, all linked with each other.  A pair
of which one list is that long is linked there; all lists of any other pair count.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Workspace, fresh
from tidemark.llm.components import connected_components

SEED = 42
_BLOCK = 1 << 16
#: The blocks of the Steiner system S(3, 4, 8): the planes of three-bit vectors, four positions whose numbers cancel out.
_CHOICES = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 bytes; words are split at ASCII white space and A-Z lowered."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    if n < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)  # one shingle: over half of one is that one
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _BLOCK):
        part = np.array(hashes[k : k + _BLOCK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)``, fp being the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            got = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], names=["id", "fp"])

    kind = docs.select(F.col(id_col).alias("id")).dtypes[0][1]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _postings(fps: DataFrame) -> DataFrame:
    """``(choice, key, fp)``: one row for each choice of four positional bytes."""
    masks = [sum(255 << 8 * b for b in c) for c in _CHOICES]
    keys = [F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for n, m in enumerate(masks)]
    return fps.select("fp", F.inline(F.array(*keys)))


def links(fps: DataFrame, ws: Workspace, max_bits: int = 2, light: int = 64) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the distinct fingerprints within ``max_bits`` (1 or 2) of each other."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits is 1 or 2")
    posted = _postings(fps)
    sizes = posted.groupBy("choice", "key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = ws.table(posted.join(sizes, ["choice", "key"]), "postings")
    lists = shared.filter(F.col("size") <= light).groupBy("choice", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = lists.select("fps", F.posexplode("fps").alias("at", "a")).select("a", F.explode(F.expr("slice(fps, at + 2, size(fps))")).alias("b"))
    tally = pairs.groupBy("a", "b").agg(F.count("*").alias("met"))
    near = tally.filter(F.col("met") >= (3 if max_bits == 2 else 7)).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")
    crowd = shared.filter(F.col("size") > light).select("fp").distinct()
    flips = [F.lit(0), *[F.expr(f"shiftleft(1L, {b})") for b in range(64)]]
    moved = crowd.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("mid"))
    if max_bits == 1:
        stars = moved.filter("mid > fp").join(crowd.select(F.col("fp").alias("mid")), "mid").select(F.col("fp").alias("a"), F.col("mid").alias("b"))
    else:
        around = moved.groupBy("mid").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter("size(all) > 1")  # 65 at most
        stars = around.select("a", F.explode("all").alias("b")).filter("a <> b").distinct()
    return near.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, light: int = 64) -> DataFrame:
    """One row per input row: ``(id, fingerprint, component_id, component_size)``.

    ``component_id`` is the smallest id reachable over links of at most ``max_bits`` differing bits; rows of one
    fingerprint are linked.  Null and empty texts have the fingerprint zero and are linked like any other; null ids
    keep their row and take the smallest other id of their component (null if there is none); repeated rows count each;
    further columns are ignored; an empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    marked = ws.table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = ws.table(marked.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("rows")), "distinct")
    roots = _roots(distinct, ws, max_bits, light)
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    components = placed.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("rows").alias("component_size"))
    named = placed.select("fp", "root").join(components, "root").drop("root")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def _roots(distinct: DataFrame, ws: Workspace, max_bits: int, light: int) -> DataFrame:
    """``(fp, root)`` of fingerprints that have a link."""
    edges = ws.table(links(distinct.select("fp"), ws, max_bits, light), "links")
    ws.drop("postings")
    roots = connected_components(edges, ws).withColumnRenamed("node", "fp")
    ws.drop("links")
    return roots


def _row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes of a whole row; rows equal in both are taken for repeated ones."""
    plain = [F.col(f"`{f.name}`") if isinstance(f.dataType, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType)) else F.col(f"`{f.name}`").cast("string") for f in docs.schema.fields]
    present = F.array(*[x.isNull() for x in plain])  # a null leaves a hash as it was
    return [F.xxhash64(F.lit(n), present, *plain) for n in (1, 2)]


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, light: int = 64) -> DataFrame:
    """The input's columns and, of each component, one row: that with the smallest id, null ids last.

    Of rows with one id the choice is by a hash of the row; of repeated rows one stays.  Null and empty texts are one
    component.  Rows are told apart by hashes of their own, so no copy of the table is kept; columns of any names pass
    through; an empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "groups")
    h1, h2 = fresh(docs, "h1", "h2")
    keyed = docs.withColumns(dict(zip((h1, h2), _row_keys(docs), strict=True)))
    (ident,) = fresh(keyed, "ident")
    seen = keyed.select(F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(h1).alias("h1"), F.col(h2).alias("h2")).alias(ident), F.col(f"`{text_col}`").alias("text"))
    marked = ws.table(fingerprints(seen, ident, "text", shingle), "fingerprints")
    distinct = ws.table(marked.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("rows")), "distinct")
    placed = distinct.join(_roots(distinct, ws, max_bits, light), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = placed.groupBy("root").agg(F.min("low").alias("id"))
    again = marked.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    kept = ws.table(first.join(again, "id", "left").select(F.col("id.h1").alias(h1), F.col("id.h2").alias(h2), F.col("n").isNotNull().alias("again")), "kept")
    ws.drop("distinct", "fingerprints")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = keyed.join(kept.filter("not again").select(h1, h2), [h1, h2], "left_semi").select(*columns)
    if kept.filter("again").isEmpty():
        return once
    # repeated rows: written first, so that a row repeated very often is split, then reduced by every task before they meet
    rows = ws.table(keyed.join(kept.filter("again").select(h1, h2), [h1, h2], "left_semi"), "repeated", compression="zstd")
    return once.union(rows.groupBy(h1, h2).agg(F.first(F.struct(*columns)).alias("row")).select("row.*"))
