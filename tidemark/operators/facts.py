"""Facts (entity, attribute, value) as a log of revisions.

``log`` tables have ``seq, op ('upsert' or 'remove'), entity, attribute, value, id, ts_ms, pinned`` and may have
``metadata`` and ``supersedes``.  Everything is a window over a key's operations in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.common import checkpointed

KEY = ["entity", "attribute"]


def versions(log: DataFrame) -> DataFrame:
    """All upserts with their version, which counts on from 1 after each removal."""
    by = Window.partitionBy(*KEY).orderBy("seq")
    part = F.sum(F.when(F.col("op") == "remove", 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    parted = log.withColumn("life", part).filter("op = 'upsert'")
    return parted.withColumn("version", F.row_number().over(Window.partitionBy(*KEY, "life").orderBy("seq")))


def latest(log: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """The current facts, or those of a time: keys whose last operation is an upsert, with its version."""
    if as_of_ms is not None:
        log = log.filter(F.col("ts_ms") <= as_of_ms)
    last = log.groupBy(*KEY).agg(F.max("seq").alias("last"))
    return versions(log).join(last, KEY).filter("seq = last").drop("life", "last", "op")


def by_prefix(facts: DataFrame, prefix: str = "", limit: int = 32) -> DataFrame:
    """Facts whose entity begins so, by entity, attribute and id; a limit of 0 gives none, a negative one all."""
    rows = facts.filter(F.startswith("entity", F.lit(prefix))) if prefix else facts
    return rows.limit(0) if limit == 0 else rows.orderBy("entity", "attribute", "id") if limit < 0 else rows.orderBy("entity", "attribute", "id").limit(limit)


def histories(revisions: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """``(head, id, step)``: the revisions of each fact in ``heads(id)`` along ``supersedes``, the head itself at step 0.

    Without ``heads``, all revisions that none supersedes.  Each round doubles the length of the paths that are followed,
    whatever the depth; a cycle ends where it comes back to a revision, a chain before one that is not there.  Rounds are
    checkpointed, so the plan stays short.
    """
    ids = revisions.select("id").distinct()
    links = revisions.filter("supersedes is not null").select("id", F.col("supersedes").alias("to")).distinct()
    if heads is None:
        heads = ids.join(links.select(F.col("to").alias("id")), "id", "left_anti")
    jump = links.join(ids.withColumnRenamed("id", "to"), "to", "left_semi").select("id", "to")
    paths, held, hops = heads.select("id").distinct().join(ids, "id", "left_semi").select(F.col("id").alias("head"), "id", F.lit(0).alias("step")), -1, 1
    while True:
        paths = checkpointed(paths)
        if (n := paths.count()) == held:
            return paths
        held, jump = n, checkpointed(jump)
        further = paths.join(jump, "id").select("head", F.col("to").alias("id"), (F.col("step") + hops).alias("step"))
        paths = paths.union(further).groupBy("head", "id").agg(F.min("step").alias("step"))
        jump = jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")).distinct()
        hops *= 2


def history(revisions: DataFrame, id_: int) -> DataFrame:
    """The revisions of a fact from the newest on, along ``supersedes`` to the end."""
    head = revisions.filter(F.col("id") == int(id_)).select("id")
    return revisions.join(histories(revisions, head).select("id", "step"), "id").orderBy("step")


def set_pinned(facts: DataFrame, ids: list[int], pinned: bool = True) -> DataFrame:
    """Pinning a pinned fact changes nothing."""
    return facts.withColumn("pinned", F.when(F.col("id").isin(ids), F.lit(pinned)).otherwise(F.coalesce("pinned", F.lit(False))))


def check_updates(facts: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits ``updates(id, value, metadata)`` into those that apply and those that do not, with the reason.

    Only the current revision of a fact that is neither pinned nor deleted can be updated.
    """
    joined = updates.join(facts.select("id", F.lit(True).alias("known"), F.coalesce("pinned", F.lit(False)).alias("is_pinned")), "id", "left")
    reason = F.when(F.col("known").isNull(), "not current").when(F.col("is_pinned"), "pinned")
    marked = joined.withColumn("reason", reason).drop("known", "is_pinned")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def apply_updates(facts: DataFrame, updates: DataFrame) -> DataFrame:
    """New revisions of updated facts: version one up, value replaced, metadata merged with the new one winning."""
    good, _ = check_updates(facts, updates)
    new = good.select("id", F.col("value").alias("new_value"), F.col("metadata").alias("new_metadata"))
    joined = facts.join(new, "id")
    merged = F.map_concat(F.map_filter("metadata", lambda k, v: ~F.coalesce(F.map_contains_key(F.coalesce("new_metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), k), F.lit(False))), F.coalesce("new_metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    return joined.withColumns({"supersedes": F.col("id"), "value": F.col("new_value"), "metadata": merged, "version": F.col("version") + 1}).drop("id", "new_value", "new_metadata")


def remove(log: DataFrame, facts: DataFrame, ids: list[int], seq: int, ts_ms: int) -> DataFrame:
    """The log with removals of these facts; pinned ones raise an error, unknown ones do nothing."""
    picked = facts.filter(F.col("id").isin(ids))
    if picked.filter(F.coalesce("pinned", F.lit(False))).take(1):
        raise ValueError("a pinned fact cannot be removed")
    rows = picked.select(F.lit(seq).cast("bigint").alias("seq"), F.lit("remove").alias("op"), "entity", "attribute", F.lit(ts_ms).cast("bigint").alias("ts_ms"), "id")
    return log.unionByName(rows, allowMissingColumns=True)


def unique_lines(facts: DataFrame) -> DataFrame:
    """The first of facts that are equal but for case and white space."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    line = F.concat_ws("|", norm("entity"), norm("attribute"), norm("value"))
    return facts.withColumn("line", line).groupBy("line").agg(F.min("id").alias("id"))


def preview() -> F.Column:
    return F.concat_ws(" ", "entity", "attribute", "value")
