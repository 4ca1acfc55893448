"""State from append-only events, upserts without a merge command, retention and paging."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The last event of each key; ``order`` ends in a unique column."""
    best = events.groupBy(*by).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("e"))
    return best.select(*by, *(F.col(f"e.{c}").alias(c) for c in keep))


def outcomes(journal: DataFrame) -> DataFrame:
    """``(plan_id, item_id, outcome)`` from ``journal(seq, plan_id, item_id, op, status)``."""
    last = journal.groupBy("plan_id", "item_id").agg(*(F.max_by(F.when(F.col("op") == op, F.col("status")), F.when(F.col("op") == op, F.col("seq"))).alias(op) for op in ("quarantine", "restore", "purge", "skip")))
    state = F.when(F.col("purge") == "done", "purged").when(F.col("restore") == "done", "restored").when(F.col("restore") == "started", "restoring").when(F.col("quarantine") == "done", "moved")
    state = state.when(F.col("quarantine") == "failed", "failed").when(F.col("quarantine") == "started", "unfinished").when(F.col("skip").isNotNull(), "skipped").otherwise("proposed")
    return last.select("plan_id", "item_id", state.alias("outcome"))


def settle_plans(told: DataFrame) -> DataFrame:
    """``(plan_id, status, n)``: a plan's status from its items' outcomes."""
    c = told.groupBy("plan_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("outcome").isin(*names)).alias(name) for name, names in (("open", ("unfinished", "restoring")), ("bad", ("failed",)), ("back", ("restored",)), ("moved", ("moved", "purged")))))
    status = F.when(F.col("open") > 0, "unresolved").when((F.col("bad") > 0) & (F.col("moved") == 0), "error").when(F.col("bad") > 0, "partial").when((F.col("moved") == 0) & (F.col("back") > 0), "restored").when(F.col("moved") > 0, "applied").otherwise("proposed")
    return c.select("plan_id", status.alias("status"), "n")


def current_facts(facts: DataFrame, by: str, at: str, key: str) -> DataFrame:
    """The latest row of each key, and the one it supersedes."""
    order = Window.partitionBy(by).orderBy(F.desc(at), F.desc(key))
    return facts.withColumn("supersedes", F.lead(key).over(order)).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def swept(facts: DataFrame, now: Column) -> DataFrame:
    """Confirmed facts past their expiry become stale."""
    gone = (F.col("status") == "confirmed") & (F.col("expires_at") <= now)
    return facts.withColumn("status", F.when(gone, "stale").otherwise(F.col("status")))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: list[str], sticky: dict[str, list[str]] | None = None) -> DataFrame:
    """All rows of both by ``key``: new values win, but for ``keep_old`` and sticky old values."""
    sticky = sticky or {}
    o, n = old.alias("o"), new.alias("n")
    out = []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == key or c in keep_old:
            out.append(F.coalesce(a, b).alias(c))
        elif c in sticky:
            out.append(F.when(a.isin(*sticky[c]), a).when(F.col(f"n.{key}").isNotNull(), b).otherwise(a).alias(c))
        else:
            out.append(F.when(F.col(f"n.{key}").isNotNull(), b).otherwise(a).alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*out)


def counters(events: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """``(by, times, last)``: how often each key was seen, and its last value."""
    return events.groupBy(*by).agg(F.count("*").alias("times"), F.max_by(value, F.struct(*order)).alias("last"))


def newest(rows: DataFrame, at: str, key: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows, ties by key; a bounded top-k, never a global sort."""
    return rows.orderBy(F.desc(at), key).limit(keep)


def evict(preferences: DataFrame, keep: int) -> DataFrame:
    """The preferences that stay: rejected ones go first, then the rarest, then the oldest."""
    return preferences.orderBy((F.col("kind") == "rejected").asc(), F.desc("times"), F.desc("at"), F.desc("id")).limit(keep)


def greedy_prefix(groups: DataFrame, weight: str, order: list, most: int, most_groups: int = 1000) -> DataFrame:
    """The groups, in order, before the first one that would be one of more than ``most_groups`` or
    whose running sum passes ``most``; the sort is a bounded top-k."""
    head = groups.orderBy(*order).limit(most_groups)
    return head.withColumn("running", F.sum(weight).over(Window.orderBy(*order))).where(F.col("running") <= most)


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page; limit is held to 1..100, and an offset past the end gives the last page."""
    limit = max(1, min(100, limit))
    n = rows.count()
    last = max(0, (math.ceil(n / limit) - 1) * limit)
    return rows.orderBy(*order).offset(min(max(0, offset), last)).limit(limit)


def missing(known: DataFrame, found: DataFrame, key: str, guard: int = 10) -> DataFrame:
    """Known rows that were not found; none if all of at least ``guard`` are gone, as with a lost disk."""
    gone = known.join(found.select(key).distinct(), key, "left_anti")
    n, lost = known.count(), gone.count()
    return gone.limit(0) if lost == n and n >= guard else gone


def stale(proposed: DataFrame, current: DataFrame, by: list[str], exempt: str = "duplicate") -> DataFrame:
    """Proposed candidates that no rule gives any more; one kind has a sweep of its own."""
    return proposed.where(F.col("kind") != exempt).join(current.select(*by).distinct(), by, "left_anti")
