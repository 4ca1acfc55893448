"""Facts from a history of commands: candidates, confirmations that supersede, and an undo stack.

Commands are ``(owner, seq, op, fact_id, key, value, n)``. propose adds a candidate; confirm makes a
candidate the key's confirmed fact and supersedes the one before; reject takes any fact back; manual
proposes and confirms at once; undo takes the last n entries of the owner's journal back, and a
command that is not allowed leaves no entry. Because undo takes from the top, the entries that are
left say all: a fact's status is that of its last entry.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.operators.fold import folded

FACTS = "fact_id long, key string, value string, status string, supersedes long, seq long"


class Journal:
    """The entries of one owner that have not been undone, and what they say of facts and keys.

    >>> j = Journal()
    >>> for seq, op, fact in ((1, "manual", 1), (2, "propose", 2), (3, "confirm", 2), (4, "confirm", 2)):
    ...     _ = j.add({"seq": seq, "op": op, "fact_id": fact, "key": "k", "value": str(fact), "n": 0})
    >>> [(x[0], x[3], x[4]) for x in j.end()], len(j.entries)
    ([(1, 'superseded', None), (2, 'confirmed', 1)], 4)
    >>> _ = j.add({"seq": 5, "op": "undo", "fact_id": None, "key": None, "value": None, "n": 2})
    >>> [(x[0], x[3]) for x in j.end()]
    [(1, 'confirmed')]
    """

    def __init__(self) -> None:
        self.entries: list[tuple[str, int, str, str, int | None, int]] = []  # op, fact, key, value, superseded, seq
        self.ops: dict[int, list[str]] = {}  # of a fact
        self.key_of: dict[int, str] = {}
        self.confirmed: dict[str, list[int]] = {}  # facts confirmed for a key, in order

    def _push(self, op: str, fact: int, key: str, value: str, seq: int) -> None:
        before = None
        if op == "confirm":
            last = self.confirmed.setdefault(key, [])
            before = last[-1] if last and self.ops[last[-1]][-1] == "confirm" else None
            last.append(fact)
        self.entries.append((op, fact, key, value, before, seq))
        self.ops.setdefault(fact, []).append(op)
        self.key_of[fact] = key

    def _pop(self) -> None:
        op, fact, key, *_ = self.entries.pop()
        self.ops[fact].pop()
        if op == "confirm":
            self.confirmed[key].pop()
        if not self.ops[fact]:
            del self.ops[fact], self.key_of[fact]

    def add(self, row: dict) -> Iterable[tuple]:
        op, fact, seq = row["op"], row["fact_id"], row["seq"]
        known = self.ops.get(fact)
        if op in ("propose", "manual"):
            if fact is not None and not known:
                self._push("propose", fact, row["key"], row["value"], seq)
                if op == "manual":
                    self._push("confirm", fact, row["key"], row["value"], seq)
        elif op == "confirm" and known and known[-1] == "propose" or op == "reject" and known:
            self._push(op, fact, self.key_of[fact], row["value"], seq)
        elif op == "undo":
            for _ in range(min(row["n"] or 0, len(self.entries))):
                self._pop()
        return ()

    def end(self) -> Iterable[tuple]:
        told: dict[int, tuple] = {}
        for op, fact, key, value, before, seq in self.entries:
            if op == "propose":
                told[fact] = (key, value, "candidate", None, seq)
            else:
                key, value, _, supersedes, _ = told[fact]
                told[fact] = (key, value, "rejected", supersedes, seq) if op == "reject" else (key, value, "confirmed", before, seq)
                if before is not None:
                    old = told[before]
                    told[before] = (*old[:2], "superseded", *old[3:])
        return [(fact, *x) for fact, x in told.items()]


def history(commands: DataFrame) -> DataFrame:
    """``(owner, fact_id, key, value, status, supersedes, seq)`` of every fact that is left, seq of its last entry.

    Confirming what is no candidate, rejecting what is not there and proposing an id again have no
    effect; so has a null fact_id. undo goes back to the owner's first entry at most. seq is unique
    for an owner. An empty table gives no rows; other columns are ignored.
    """
    return folded(commands.select("owner", "seq", "op", "fact_id", "key", "value", "n"), ["owner"], ["seq"], Journal, FACTS)


def current(facts: DataFrame) -> DataFrame:
    """The confirmed fact of each owner and key."""
    return facts.where(F.col("status") == "confirmed").select("owner", "key", "fact_id", "value", "seq")
