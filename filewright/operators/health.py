"""What a dashboard shows: the quarantine from its journal, the state of the whole, and counts of a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Fixed value: days that a file stays in quarantine before it may be emptied.
RETENTION_DAYS = 7


def quarantine(journal: DataFrame, details: DataFrame, purges: DataFrame, n_on_disk: int | Column, n_reserved: int | Column = 0) -> DataFrame:
    """One row ``(items, bytes, oldest_mtime, can_empty_at, orphans, truncated)``.

    ``journal(seq, plan_id, item_id, op, status)`` with ``details(seq, completed_at, bytes, mtime)``; a
    move counts if it is done, not restored and, by ``purges(seq, status)``, not purged. can_empty_at is
    the end of the earliest retention among those that no restore has begun for; a move without a
    time makes the list truncated. orphans are files on disk beyond those and the reserved ones, never
    below none; a negative ``n_on_disk`` is unknown. An empty journal gives one row of zeros.
    """
    moves = journal.where("op = 'quarantine' and status = 'done'").select("seq", "plan_id", "item_id").join(details.select("seq", "completed_at", "bytes", "mtime"), "seq")
    back = journal.where("op = 'restore'").groupBy("plan_id", "item_id").agg(F.bool_or(F.col("status") == "done").alias("restored"), F.bool_or(F.col("status") == "started").alias("restoring"))
    gone = purges.where("status = 'done'").select("seq").distinct()
    active = moves.join(back, ["plan_id", "item_id"], "left").where("not coalesce(restored, false)").join(gone, "seq", "left_anti")
    waits = ~F.coalesce("restoring", F.lit(False))
    ready = F.min(F.when(waits, F.col("completed_at"))) + F.expr(f"interval {RETENTION_DAYS} days")
    one = active.agg(F.count("*").alias("items"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("mtime").alias("oldest_mtime"), ready.alias("can_empty_at"), F.count_if(waits & F.col("completed_at").isNull()).alias("untimed"))
    disk = n_on_disk if isinstance(n_on_disk, Column) else F.lit(n_on_disk)
    reserved = n_reserved if isinstance(n_reserved, Column) else F.lit(n_reserved)
    orphans = F.when(disk < 0, F.lit(0)).otherwise(F.greatest(F.lit(0), disk - F.col("items") - reserved)).cast("long")
    return one.select("items", "bytes", "oldest_mtime", "can_empty_at", orphans.alias("orphans"), ((F.col("untimed") > 0) | (disk < 0)).alias("truncated"))


def can_empty(row: DataFrame, now: Column) -> DataFrame:
    """``row`` of :func:`quarantine` with can_empty_now: something is there, all of it is known, and its time has come."""
    holds = (F.col("items") > 0) & ~F.col("truncated") & (F.col("can_empty_at") <= now)
    return row.withColumn("can_empty_now", F.coalesce(holds, F.lit(False)))


def state(row: DataFrame) -> DataFrame:
    """``row`` with state, the first that holds: worried, waiting, found, watching, idle.

    ``row`` has healthy, has_error, roots_missing, problems, proposed_plans, ready and watching; nulls
    count as nothing.
    """

    def some(name: str) -> Column:
        return F.coalesce(F.col(name) > 0, F.lit(False))

    def true(name: str) -> Column:
        return F.coalesce(name, F.lit(False))

    worried = ~true("healthy") | true("has_error") | some("roots_missing") | some("problems")
    return row.withColumn("state", F.when(worried, "worried").when(some("proposed_plans"), "waiting").when(some("ready"), "found").when(true("watching"), "watching").otherwise("idle"))


def counted(rows: DataFrame, name: str, /, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``rows`` and what will be known of them after the next action: metrics come from the pass that is made anyway."""
    seen = Observation(name)
    return rows.observe(seen, *(metric.alias(label) for label, metric in metrics.items())), seen
