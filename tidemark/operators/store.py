"""The frame store: generations, the mutation log and its fold, compaction, checks and statistics."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import any_of
from tidemark.operators.common import checkpointed, small


def fold_mutations(log: DataFrame) -> DataFrame:
    """``(frame_id, ts_ms, text, status, supersedes, superseded_by)`` after a log of ``put``, ``delete``, ``supersede`` rows.

    Rows count in order of ``seq``; those that ``mutation_errors`` names are left out.  A supersede names the old frame
    in ``frame_id`` and the new one in ``other_id``.  A store that refuses a log with any such row asks for them first
    (``FrameStore.apply``).
    """
    born = _born(log)
    puts = log.filter("kind = 'put'").groupBy("frame_id").agg(F.min_by(F.struct("ts_ms", "text"), "seq").alias("put")).select("frame_id", "put.*")
    gone = log.filter("kind = 'delete'").join(born, "frame_id").filter("seq > born").select("frame_id").distinct().withColumn("gone", F.lit(1))
    links = _links(log)
    closing = _closing(links)
    links = links.join(closing, "seq", "left_anti")
    newer = links.groupBy(F.col("old").alias("frame_id")).agg(F.min_by("new", "seq").alias("superseded_by"))
    older = links.groupBy(F.col("new").alias("frame_id")).agg(F.min_by("old", "seq").alias("supersedes"))
    rows = puts.join(gone, "frame_id", "left").join(newer, "frame_id", "left").join(older, "frame_id", "left")
    return rows.select("frame_id", "ts_ms", "text", F.coalesce("gone", F.lit(0)).alias("status"), "supersedes", "superseded_by")


def _born(log: DataFrame) -> DataFrame:
    return log.filter("kind = 'put'").groupBy("frame_id").agg(F.min("seq").alias("born"))


def _real_links(log: DataFrame) -> DataFrame:
    """``(seq, old, new)`` of the supersedes between two frames that were there by then."""
    born = _born(log)
    links = log.filter("kind = 'supersede' and frame_id <> other_id").select("seq", F.col("frame_id").alias("old"), F.col("other_id").alias("new"))
    for end in ("old", "new"):
        links = links.join(born.select(F.col("frame_id").alias(end), "born"), end).filter("seq > born").drop("born")
    return links


def _judged(links: DataFrame) -> DataFrame:
    """Links with ``holds``: true for those that agree with the first link at either end."""
    first = lambda key, other: F.first(other).over(Window.partitionBy(key).orderBy("seq"))
    return links.withColumn("a", first("old", "new")).withColumn("b", first("new", "old")).withColumn("holds", (F.col("a") == F.col("new")) & (F.col("b") == F.col("old"))).drop("a", "b")


def _links(log: DataFrame) -> DataFrame:
    """The supersedes that hold but for cycles: no frame has two successors or two predecessors among them."""
    return _judged(_real_links(log)).filter("holds").select("seq", "old", "new")


def _closing(links: DataFrame) -> DataFrame:
    """``(seq)``: the last link of each cycle, that which closes it; its repeats too."""
    once = links.groupBy("old", "new").agg(F.min("seq").alias("seq"))
    members = supersede_cycles(once.select("old", "new")).select(F.col("node").alias("old"), "cycle")
    last = once.join(members, "old").groupBy("cycle").agg(F.max("seq").alias("seq"))
    return links.join(once.join(last, "seq", "left_semi").select("old", "new"), ["old", "new"], "left_semi").select("seq")


def mutation_errors(log: DataFrame, dim: int | None = None) -> DataFrame:
    """``(seq, error)``: ids that are not dense, unknown frames, links to itself or to several frames, cycles, wrong vectors.

    A link is a conflict if it differs from the first link at either of its frames; of a cycle, the link that closes it
    is the error.
    """
    puts = log.filter("kind = 'put'")
    count = puts.agg(F.count("*").alias("n"))
    sparse = puts.crossJoin(F.broadcast(count)).filter("frame_id < 0 or frame_id >= n").select("seq", F.lit("id out of range").alias("error"))
    twice = puts.withColumn("_n", F.row_number().over(Window.partitionBy("frame_id").orderBy("seq"))).filter("_n > 1").select("seq", F.lit("id used twice").alias("error"))
    use = log.filter("kind <> 'put'").select("seq", F.explode(F.array_compact(F.array("frame_id", "other_id"))).alias("frame_id"))
    unknown = use.join(_born(log), "frame_id", "left").filter("born is null or born > seq").select("seq", F.lit("unknown frame").alias("error")).distinct()
    own = log.filter("kind = 'supersede' and frame_id = other_id").select("seq", F.lit("supersedes itself").alias("error"))
    conflict = _judged(_real_links(log)).filter("not holds").select("seq", F.lit("conflicting link").alias("error"))
    cycle = _closing(_links(log)).select("seq", F.lit("cycle").alias("error"))
    out = sparse.union(twice).union(unknown).union(own).union(conflict).union(cycle)
    if dim is not None and "vector" in log.columns:
        out = out.union(log.filter("kind = 'embedding'").filter(F.size("vector") != dim).select("seq", F.lit("wrong dimension").alias("error")))
    return out


def supersede_tips(links: DataFrame) -> DataFrame:
    """``(root, tip, hops)`` of ``links(old, new)``: where each chain begins and ends, however long it is.

    Each round doubles the length of the hops; of several links from one frame the one to the smallest counts; chains
    that run into a cycle have no tip and are left out.  Rounds are checkpointed, so the plan stays short.
    """
    jump = checkpointed(links.groupBy("old").agg(F.min("new").alias("new")).withColumn("hops", F.lit(1)))
    roots = jump.join(links.select(F.col("new").alias("old")), "old", "left_anti")
    done, going, total, reach = None, checkpointed(roots.select(F.col("old").alias("root"), F.col("new").alias("tip"), "hops")), jump.count(), 1
    while True:
        step = going.join(jump.select(F.col("old").alias("tip"), F.col("new").alias("next"), F.col("hops").alias("more")), "tip", "left")
        ended = step.filter("next is null").select("root", "tip", "hops")
        done = checkpointed(ended if done is None else done.union(ended))
        going = checkpointed(step.filter("next is not null").select("root", F.col("next").alias("tip"), (F.col("hops") + F.col("more")).alias("hops")))
        if reach > total or not going.take(1):
            return done
        longer = jump.join(jump.select(F.col("old").alias("new"), F.col("new").alias("next"), F.col("hops").alias("more")), "new", "left")
        # one that cannot go so far goes as far as it can, so no walk overshoots
        jump = checkpointed(longer.select("old", F.coalesce("next", "new").alias("new"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
        reach *= 2


def supersede_cycles(links: DataFrame) -> DataFrame:
    """``(node, cycle)``: frames on or before a cycle of ``links(old, new)``, and the smallest frame of that cycle.

    Each round doubles the length of the paths that are followed, so chains drop out once they have ended; when a round
    drops none, what is left never ends.  Rounds are checkpointed, so the plan stays short.
    """
    jump = checkpointed(links.groupBy("old").agg(F.min("new").alias("new")).withColumn("cycle", F.col("new")))
    held, reach = jump.count(), 1
    while held and reach <= 2 * held:
        after = jump.select(F.col("old").alias("new"), F.col("new").alias("next"), F.col("cycle").alias("low"))
        jump = checkpointed(jump.join(after, "new").select("old", F.col("next").alias("new"), F.least("cycle", "low").alias("cycle")))
        held, reach = jump.count(), 2 * reach
    # the walk from a frame before the cycle has met smaller ones on its way; where it stands now is on the cycle
    at = jump.select(F.col("old").alias("new"), F.col("cycle").alias("own"))
    return jump.join(at, "new").select(F.col("old").alias("node"), F.col("own").alias("cycle")).distinct()


def surrogate_map(links: DataFrame) -> DataFrame:
    """``(tip, root)``: what is now in the place of each superseded original; of several originals the smallest."""
    return supersede_tips(links).groupBy("tip").agg(F.min("root").alias("root"))


def lookup(frames: DataFrame, ids: DataFrame, payload: bool = True) -> DataFrame:
    """The frames of ``ids(frame_id)``, each once, without their texts if ``payload`` is false; unknown ids give nothing."""
    rows = frames if payload else frames.drop("text")
    return rows.join(small(ids.select("frame_id").distinct()), "frame_id", "left_semi")


def is_internal(text: Column, marks: tuple[str, ...]) -> Column:
    """True for payloads that begin with one of a store's own marks and are no user's text."""
    return F.coalesce(any_of([F.startswith(text, F.lit(m)) for m in marks]), F.lit(False)) if marks else F.lit(False)


def active(frames: DataFrame) -> DataFrame:
    """Frames that are not deleted, superseded ones included."""
    return frames.filter("status = 0")


def pending(log: DataFrame, committed_seq: int) -> DataFrame:
    """The rows of a mutation log that a store has not applied yet, one for each ``seq``."""
    return log.filter(F.col("seq") > committed_seq).dropDuplicates(["seq"])


def overlay(frames: DataFrame, log: DataFrame, committed_seq: int) -> DataFrame:
    """Frames as they will be once the pending rows of ``log`` are applied: new ones, and changed states of old ones."""
    states = frames.select(F.lit(-1).cast("bigint").alias("seq"), F.lit("put").alias("kind"), "frame_id", F.lit(None).cast("bigint").alias("other_id"), "ts_ms", "text")
    links = frames.filter("superseded_by is not null").select(F.lit(0).cast("bigint").alias("seq"), F.lit("supersede").alias("kind"), "frame_id", F.col("superseded_by").alias("other_id"), "ts_ms", F.lit(None).cast("string").alias("text"))
    gone = frames.filter("status <> 0").select(F.lit(0).cast("bigint").alias("seq"), F.lit("delete").alias("kind"), "frame_id", F.lit(None).cast("bigint").alias("other_id"), "ts_ms", F.lit(None).cast("string").alias("text"))
    later = pending(log, committed_seq).select((F.col("seq") + 1).alias("seq"), "kind", "frame_id", "other_id", "ts_ms", "text")
    return fold_mutations(states.unionByName(links).unionByName(gone).unionByName(later.filter("seq > 0")))


def verify(frames: DataFrame) -> DataFrame:
    """Frames whose text does not have the stored checksum; none in a sound store."""
    return frames.filter(F.sha2(F.encode("text", "UTF-8"), 256) != F.col("sha256")).select("frame_id")


def live(frames: DataFrame) -> DataFrame:
    return frames.filter("status = 0 and superseded_by is null")


def payload_stats(frames: DataFrame) -> DataFrame:
    """One row: bytes of all and of dead payloads, their share, and how many frames are live, deleted, superseded."""
    size, dead = F.octet_length("text").cast("bigint"), (F.col("status") != 0) | F.col("superseded_by").isNotNull()
    rows = frames.agg(
        F.count("*").alias("frames"), F.count_if(~dead).alias("live"), F.count_if(F.col("status") != 0).alias("deleted"),
        F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum(F.when(dead, size)), F.lit(0)).alias("dead_bytes"),
    )
    return rows.withColumn("dead_share", F.when(F.col("total_bytes") == 0, 0.0).otherwise(F.round(F.col("dead_bytes") / F.col("total_bytes"), 6)))


@dataclass(frozen=True)
class MaintenanceGate:
    """When a store is compacted; thresholds as they are published."""

    every: int = 32
    dead_bytes: int = 64 << 20
    dead_share: float = 0.25
    idle_ms: int = 15_000
    interval_ms: int = 300_000

    def outcome(self) -> Column:
        """Over ``(enabled, force, flush, now_ms, last_done_ms, last_write_ms, dead_bytes, total_bytes)``: the first reason not to run, or ``run``."""
        share = F.when(F.col("total_bytes") > 0, F.col("dead_bytes") / F.col("total_bytes")).otherwise(0.0)
        return (
            F.when(~F.col("enabled"), "disabled").when(F.col("force"), "run")
            .when(F.lit(self.every > 1) & (F.col("flush") % max(1, self.every) != 0), "cadence")
            .when(F.col("now_ms") - F.col("last_done_ms") < self.interval_ms, "cooldown")
            .when(F.col("now_ms") - F.col("last_write_ms") < self.idle_ms, "not idle")
            .when((F.col("dead_bytes") < self.dead_bytes) & (share < self.dead_share), "below threshold")
            .otherwise("run")
        )


class Conflict(RuntimeError):
    """Another writer has committed since."""


class FrameStore:
    """Tables of one root folder, each a list of immutable parts; a numbered pointer file names what readers see.

    A commit writes new parts to a folder of its own and then, last, the next pointer, which must not be there yet: a
    commit that breaks off, or that another writer overtook, leaves readers where they were.  Tables are replaced or
    appended to.  Staged tables wait in a folder that no reader sees until they are committed or rolled back.  The
    latest ``keep`` pointers and what they list stay.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.staged: dict[str, tuple[str, bool]] = {}

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _names(self, start: str) -> list[str]:
        fs = self._fs()
        if not fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path(""))]
        return sorted(n for n in names if n.startswith(start))

    def generations(self) -> list[int]:
        return sorted(int(n.removeprefix("current-")) for n in self._names("current-"))

    def current(self) -> int | None:
        return max(self.generations(), default=None)

    def tables(self, generation: int | None = None) -> dict[str, list[str]]:
        """The parts of each table, oldest first."""
        generation = self.current() if generation is None else generation
        if generation is None:
            return {}
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.root}/current-{generation}").collect()) or "{}")

    def read(self, table: str, generation: int | None = None, staged: bool = False) -> DataFrame:
        """A table as committed, or as it will be with what is staged."""
        parts = self.tables(generation).get(table, [])
        if staged and table in self.staged:
            folder, append = self.staged[table]
            parts = [*(parts if append else []), folder]
        if not parts:
            raise FileNotFoundError(f"no table {table} at {self.root}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.spark.read.parquet(f"{self.root}/{p}") for p in parts])

    def read_or_empty(self, table: str, schema: str) -> DataFrame:
        return self.read(table) if table in self.tables() else self.spark.createDataFrame([], schema)

    def stage(self, tables: dict[str, DataFrame], append: dict[str, DataFrame] | None = None) -> None:
        """Writes tables that replace or extend committed ones, out of readers' sight; staging a table anew replaces it."""
        folder = f"parts-{uuid.uuid4().hex}"
        for rows, extends in ((tables, False), (append or {}, True)):
            for name, table in rows.items():
                table.write.parquet(f"{self.root}/{folder}/{name}")
                self.staged[name] = f"{folder}/{name}", extends

    def rollback(self) -> None:
        """Drops what is staged."""
        for folder in {f.split("/")[0] for f, _ in self.staged.values()}:
            self._fs().delete(self._path(folder), True)
        self.staged.clear()

    def commit(self, tables: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, expect: int | None = -1) -> int:
        """Makes staged tables, and these, the next generation; all others stay as they are.

        ``expect`` is the generation that the tables were made from (the current one, if none is given); if another
        writer has committed since, ``Conflict`` is raised and nothing changes.
        """
        last = self.current() if expect == -1 else expect
        number = 0 if last is None else last + 1
        self.stage(tables or {}, append)
        held = self.tables(last)
        for name, (folder, extends) in self.staged.items():
            held[name] = [*(held.get(name, []) if extends else []), folder]
        fs = self._fs()
        try:
            out = fs.create(self._path(f"current-{number}"), False)
        except Exception as e:
            self.rollback()
            raise Conflict(f"generation {number} is there already") from e
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        self.staged.clear()
        for old in self.generations()[: -self.keep]:
            gone = self.tables(old)
            fs.delete(self._path(f"current-{old}"), True)
            used = {p for n in self.generations() for parts in self.tables(n).values() for p in parts}
            for part in {p for parts in gone.values() for p in parts} - used:
                fs.delete(self._path(part), True)
        return number

    def sweep(self) -> int:
        """Deletes folders that no pointer lists, such as those of commits that broke off; not while others write."""
        used = {p.split("/")[0] for n in self.generations() for parts in self.tables(n).values() for p in parts} | {f.split("/")[0] for f, _ in self.staged.values()}
        old = [n for n in self._names("parts-") if n not in used]
        for name in old:
            self._fs().delete(self._path(name), True)
        return len(old)

    def apply(self, log: DataFrame, table: str = "frames") -> int:
        """Commits the frames of a mutation log; one with errors is refused as a whole."""
        bad = mutation_errors(log).orderBy("seq").first()
        if bad:
            raise ValueError(f"mutation {bad['seq']}: {bad['error']}")
        return self.commit({table: fold_mutations(log)})

    def compact(self, frames: str = "frames") -> int:
        """Drops dead frames, keeping ids and links to frames that stay; other tables keep the rows of live frames.

        Every table becomes one part.  The new frames are counted before they are committed: if they are not exactly the
        live ones, the rewrite is rolled back.
        """
        last = self.current()
        alive = live(self.read(frames))
        want = alive.count()
        out = {frames: alive}
        for name in self.tables():
            if name != frames:
                rows = self.read(name)
                out[name] = rows.join(alive.select("frame_id"), "frame_id", "left_semi") if "frame_id" in rows.columns else rows
        self.stage(out)
        if (got := self.read(frames, staged=True).count()) != want:
            self.rollback()
            raise RuntimeError(f"{got} frames were written of {want}")
        return self.commit(expect=last)

    def report(self, frames: str = "frames") -> DataFrame:
        """``(table, parts, rows, detail)``: every table, and for frames what is live, dead or damaged."""
        held, out = self.tables(), []
        for name, parts in sorted(held.items()):
            rows = self.read(name)
            detail = F.lit(None).cast("string")
            if name == frames:
                stats = payload_stats(rows).first().asDict()
                stats["damaged"] = verify(rows).count() if "sha256" in rows.columns else None
                detail = F.lit(json.dumps(stats))
            out.append(rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.lit(len(parts)).alias("parts"), "rows", detail.alias("detail")))
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], "table string, parts int, rows long, detail string")


def append_frames(frames: DataFrame, new: DataFrame) -> DataFrame:
    """``new(ord, ts_ms, text, metadata)`` behind the frames that are there: see ``new_frames``."""
    return frames.unionByName(new_frames(frames, new), allowMissingColumns=True)


def new_frames(frames: DataFrame, new: DataFrame) -> DataFrame:
    """``new(ord, ts_ms, text, metadata)`` as frames with dense ids in order, checksum, kind and labels from metadata.

    Rows are sorted and written once with the number that each has within its range; ids come from the counts of those
    ranges over the same written rows, so no task numbers all of them and no plan is made twice.
    """
    start = frames.agg(F.coalesce(F.max("frame_id") + 1, F.lit(0)).alias("start"))
    parts = checkpointed(new.repartitionByRange("ord").sortWithinPartitions("ord").withColumn("_m", F.monotonically_increasing_id()))
    parts = parts.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    counted = parts.groupBy("_p").agg(F.count("*").alias("n"))
    offset = counted.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    placed = parts.join(F.broadcast(offset.select("_p", "before")), "_p", "left").crossJoin(F.broadcast(start))
    labels = F.filter(F.transform(F.split(F.coalesce(F.col("metadata")["labels"], F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return placed.select(
        (F.col("start") + F.col("before") + F.col("_i")).alias("frame_id"), "ts_ms", "text", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.lit(0).alias("status"),
        F.col("metadata")["kind"].alias("kind"), "metadata", labels.alias("labels"), F.lit(None).cast("bigint").alias("supersedes"), F.lit(None).cast("bigint").alias("superseded_by"),
    )


def latest_handoff(frames: DataFrame, project: str | None = None) -> DataFrame:
    rows = frames.filter("status = 0 and superseded_by is null and kind = 'handoff'")
    if project is not None:
        rows = rows.filter(F.col("metadata")["project"] == project)
    return rows.orderBy(F.desc("frame_id")).limit(1)


def is_user_frame(metadata: Column) -> Column:
    """True for frames that a user or an ingest wrote, as against facts that an enricher did."""
    has = lambda k: F.coalesce(F.map_contains_key(metadata, k), F.lit(False))
    return (has("source_kind") | has("chunk_id") | has("language") | has("symbol")) & ~has("enricher_kind")
