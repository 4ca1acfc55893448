"""Settling of changing files as a keyed streaming state machine, and bounded dedup of events.

A file settles once its size and time have stayed the same for two observations at least one
second apart; a deletion settles the same way. Any change starts anew. The state of a path is a
few numbers and goes once it has been emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STABLE_SECONDS, STABLE_SEEN = 1.0, 2
EVENTS = "path string, size long, mtime timestamp, gone boolean, observed_at timestamp"
SETTLED = "path string, size long, mtime timestamp, gone boolean, settled_at timestamp"
_STATE = "size long, mtime double, gone boolean, since double, seen int, emitted boolean"


def step(state: tuple | None, size: int, mtime: float, gone: bool, at: float) -> tuple[tuple, bool]:
    """The next state of one path, and whether it settles with this observation."""
    same = state is not None and (state[2] and gone or not state[2] and not gone and state[:2] == (size, mtime))
    if not same:
        return (size, mtime, gone, at, 1, False), False
    _, _, _, since, seen, emitted = state
    settles = not emitted and seen + 1 >= STABLE_SEEN and at - since >= STABLE_SECONDS
    return (size, mtime, gone, since, seen + 1, emitted or settles), settles


def _run(rows: pd.DataFrame, state: tuple | None) -> tuple[list[dict], tuple | None]:
    out = []
    for r in rows.sort_values(["observed_at", "size_"]).itertuples():
        gone = bool(r.gone)
        size, mtime = (-1, -1.0) if gone else (int(r.size_), r.mtime.timestamp())
        state, settles = step(state, size, mtime, gone, r.observed_at.timestamp())
        if settles:
            out.append({"path": r.path, "size": None if gone else size, "mtime": None if gone else r.mtime, "gone": gone, "settled_at": r.observed_at})
    return out, state


def _frame(out: list[dict]) -> pd.DataFrame:
    made = pd.DataFrame(out, columns=["path", "size", "mtime", "gone", "settled_at"])
    return made.astype({"size": "Int64", "mtime": "datetime64[ns]", "settled_at": "datetime64[ns]", "gone": bool, "path": object})


def settled(events: DataFrame) -> DataFrame:
    """Settled changes of a stream of ``EVENTS``; append mode."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else None
        for rows in frames:
            out, kept = _run(rows.rename(columns={"size": "size_"}), tuple(kept) if kept else None)
            yield _frame(out)
        if kept:
            state.update(kept)

    return events.groupBy("path").applyInPandasWithState(update, SETTLED, _STATE, "append", GroupStateTimeout.NoTimeout)


def settled_batch(events: DataFrame) -> DataFrame:
    """The same over a finished table of events: what a replay of the stream must give."""

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        return _frame(_run(rows.rename(columns={"size": "size_"}), None)[0])

    return events.groupBy("path").applyInPandas(replay, SETTLED)


def first_seen(events: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """Each key once within the watermark; keys older than it are late and dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def fresh(events: DataFrame, now, minutes: int = 10) -> DataFrame:
    """Files not changed within the last minutes; younger ones are still new."""
    return events.where(F.col("mtime") <= now - F.expr(f"interval {minutes} minutes"))
