"""Preferences learned from what a user did, in a store of bounded size.

Commands are ``(owner, seq, op, kind, k, v)``: learn counts a key and keeps its last value, reject
marks a suggestion, forget removes a key, clear removes all. Whenever a new key makes the store too
large, the lowest one goes at once: rejections first, then the rarest, then the oldest, never the one
that has just come. So what stays depends on the order of the whole history.
"""

from __future__ import annotations

from collections.abc import Iterable
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.operators.fold import folded

#: Preferences that an owner keeps, and characters of a value.
KEEP, VALUE_CHARS, KEY_CHARS = 500, 200, 1000
STORE = "kind string, k string, v string, times long, at long, born long, evicted long"


class Store:
    """One owner's preferences; a heap whose stale entries are skipped finds the lowest."""

    def __init__(self, keep: int = KEEP):
        self.keep, self.evicted = keep, 0
        self.rows: dict[tuple[str, str], tuple[str, int, int, int]] = {}  # value, times, at, born
        self.heap: list[tuple] = []

    def _rank(self, key: tuple[str, str]) -> tuple:
        _, times, at, born = self.rows[key]
        return (key[0] != "rejected", times, at, born, key)

    def add(self, row: dict) -> Iterable[tuple]:
        op, seq = row["op"], row["seq"]
        key = ("rejected" if op == "reject" else row["kind"], row["k"])
        if op == "clear":
            self.rows, self.heap, self.evicted = {}, [], 0
        elif op == "forget":
            self.rows.pop(key, None)
        elif op in ("learn", "reject") and key[0] and key[1] and len(key[1]) <= KEY_CHARS and (op == "reject" or row["v"]):
            value = "" if op == "reject" else row["v"][:VALUE_CHARS]
            known = self.rows.get(key)
            self.rows[key] = (value, known[1] + 1 if known else 1, seq, known[3] if known else seq)
            newest = self._rank(key)
            if len(self.rows) > self.keep:
                while True:
                    lowest = heappop(self.heap)
                    if lowest[-1] in self.rows and lowest == self._rank(lowest[-1]):
                        break
                del self.rows[lowest[-1]]
                self.evicted += 1
            heappush(self.heap, newest)
            if len(self.heap) > 4 * self.keep + 64:
                self.heap = sorted(self._rank(k) for k in self.rows)
        return ()

    def end(self) -> Iterable[tuple]:
        return [(kind, k, v, times, at, born, self.evicted) for (kind, k), (v, times, at, born) in self.rows.items()]


def learned(commands: DataFrame, keep: int = KEEP) -> DataFrame:
    """``(owner, kind, k, v, times, at, born, evicted)``: each owner's preferences after all commands.

    at and born are the seq of a key's last and first command, evicted how many keys the owner's store
    has lost. Empty, null or overlong keys and empty values are not learned. seq is unique for an
    owner. An empty table, or an owner who has forgotten all, gives no rows; other columns are ignored.
    """
    return folded(commands.select("owner", "seq", "op", "kind", "k", "v"), ["owner"], ["seq"], lambda: Store(keep), STORE)


def ranked(store: DataFrame) -> DataFrame:
    """``store`` with rank within its owner: the most used first, then the last confirmed."""
    from pyspark.sql import Window

    order = Window.partitionBy("owner").orderBy(F.desc("times"), F.desc("at"), "kind", "k")  # at most `keep` rows an owner
    return store.withColumn("rank", F.row_number().over(order))


def applied(suggestions: DataFrame, store: DataFrame, keys: dict[str, Column], rejected: Column) -> DataFrame:
    """``suggestions`` with a column ``learned_<kind>`` for each key column and ``was_rejected``.

    Joins by owner and key; a suggestion without a learned value has null there. The store holds a
    bounded number of rows an owner, so a suggestion meets at most one row a join.
    """
    out = suggestions
    for kind, key in {**keys, "rejected": rejected}.items():
        side = store.where(F.col("kind") == kind).select(F.col("owner").alias("__owner"), F.col("k").alias("__k"), F.col("v").alias("__v"))
        joined = out.withColumn("__key", key).join(side, (F.col("owner") == F.col("__owner")) & (F.col("__key") == F.col("__k")), "left")
        told = F.col("__k").isNotNull().alias("was_rejected") if kind == "rejected" else F.col("__v").alias(f"learned_{kind}")
        out = joined.select(*out.columns, told)
    return out
