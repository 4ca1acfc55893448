"""Operators along an order: gaps, chunks, streaks, leaders and spans."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filewright.operators.fold import folded


def micros(ts: str | Column) -> Column:
    """Microseconds of a timestamp with or without a zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def gap_segments(rows: DataFrame, by: str, at: str, tie: str, gap_seconds: int) -> DataFrame:
    """``rows`` with segment: a new one starts when more than ``gap_seconds`` pass within ``by``."""
    order = Window.partitionBy(by).orderBy(at, tie)
    opens = (micros(at) - F.lag(micros(at)).over(order) > gap_seconds * 1_000_000).cast("int")
    return rows.withColumn("__opens", F.coalesce(opens, F.lit(0))).withColumn("segment", F.sum("__opens").over(order).cast("long")).drop("__opens")


def chunks(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """``rows`` with chunk: every ``size`` rows of a group, in order, are one."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("chunk", F.floor((number - 1) / size).cast("long"))


class _Fill:
    """The chunk that is filled now: its number, its weight and its rows."""

    def __init__(self, order: str, weight: str, most: int, count: int):
        self.order, self.weight, self.most, self.count = order, weight, most, count
        self.chunk = self.sum = self.n = 0

    def add(self, row: dict) -> list[tuple]:
        weight = row[self.weight] or 0
        if self.n and (self.sum + weight > self.most or self.n >= self.count):
            self.chunk, self.sum, self.n = self.chunk + 1, 0, 0
        self.sum, self.n = self.sum + weight, self.n + 1
        return [(row[self.order], row[self.weight], self.chunk)]

    def end(self) -> list[tuple]:
        return []


def capacity_chunks(rows: DataFrame, by: str, order: str, weight: str, most: int, count: int) -> DataFrame:
    """``(by, order, weight, chunk)``: cut when the weights of a chunk would pass ``most`` or it has ``count`` rows.

    The sum starts anew at each cut, which no window frame expresses, so each group is folded in
    order, batch by batch. A row heavier than ``most`` is a chunk of its own; a null weight counts as
    nothing.
    """
    listed = rows.select(by, order, F.col(weight).cast("long").alias(weight))
    kind = rows.schema[order].dataType.simpleString()
    return folded(listed, [by], [order], lambda: _Fill(order, weight, most, count), f"{order} {kind}, {weight} long, chunk long")


def running_before(rows: DataFrame, by: list[str], order: str, value: str, block: int) -> DataFrame:
    """``rows`` with before: the sum of ``value`` over the rows of the key before it by the whole number ``order``.

    Blocks of ``block`` numbers are summed first, and only their sums run over a whole key, so a key
    with a large part of all rows is spread over as many tasks as it has blocks. ``order`` is unique
    within a key.
    """
    own = rows.withColumn("__block", F.floor(F.col(order) / block))
    sums = own.groupBy(*by, "__block").agg(F.sum(value).alias("__sum"))
    ahead = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__block", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy(*by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = own.join(sums, [*by, "__block"])
    return joined.withColumn("before", (F.col("__ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")).drop("__block", "__ahead").select(*rows.columns, "before")


def streaks(rows: DataFrame, by: str, order: list[str], failed: Column) -> DataFrame:
    """``(by, longest)``: the longest run of rows with ``failed`` in each group."""
    window = Window.partitionBy(by).orderBy(*order)
    island = F.sum((~failed).cast("int")).over(window)
    runs = rows.withColumn("__island", island).where(failed).groupBy(by, "__island").agg(F.count("*").alias("n"))
    return runs.groupBy(by).agg(F.max("n").alias("longest"))


def spans(rows: DataFrame, by: str, at: str) -> DataFrame:
    """``(by, n, span_seconds)`` of every group."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round((F.max(micros(at)) - F.min(micros(at))) / 1_000_000).cast("long").alias("span_seconds"))


def leaders(rows: DataFrame, by: list[str], key: str, at: str, signature: str, most_bits: int, gap_seconds: int | None = None, similar: Callable[[object, object], bool] | None = None) -> DataFrame:
    """``(key, leader)``: greedy leader clusters within each group, newest first.

    A row joins the newest leader that is within ``most_bits`` of it (and ``gap_seconds``, and
    ``similar`` where given); otherwise it leads. Members are compared with leaders only, so the
    relation is not transitive, and the result depends on the order, which ends in ``key``.
    Groups are meant to be the segments of one folder and size, cut to a bounded length before.
    """
    kind = dict(rows.dtypes)[key]

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["__at", key], ascending=[False, True])
        keys, ats = group[key].to_numpy(), group["__at"].to_numpy()
        bits = group[signature].to_numpy(np.int64).view(np.uint64)
        lead_at: list[int] = []
        out = []
        for n in range(len(keys)):
            found = n
            if lead_at:
                close = np.bitwise_count(bits[lead_at] ^ bits[n]) <= most_bits
                if gap_seconds is not None:
                    close &= ats[lead_at] - ats[n] <= gap_seconds * 1_000_000
                for m in np.flatnonzero(close):
                    if similar is None or similar(keys[lead_at[m]], keys[n]):
                        found = lead_at[m]
                        break
            if found == n:
                lead_at.append(n)
            out.append(keys[found])
        return pd.DataFrame({key: keys, "leader": out})

    return rows.select(*by, key, micros(at).alias("__at"), signature).groupBy(*by).applyInPandas(cluster, f"{key} {kind}, leader {kind}")
