"""Intake of new files: a keyed state machine on event-time timers, with what was there before.

A file is handled once it has stayed the same for a while. Its gate then accepts it, refuses it for
good, or refuses it for now, in which case it is tried again a few times. Files that were there
before the stream began are the initial state and are not emitted. What has been handled is
remembered for a time; files without a record that are older than that were forgotten, not new.
State of a path is a few numbers, and goes with its last timer. A call from Python to the state store
costs more than all work on a path, so paths are dealt into groups with one state and one timer each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from filewright.session import shared_path

#: Observations of a file: its fingerprint, whether it is gone, and what the gate says of it as it is.
OBSERVED = "path string, size long, mtime long, gone boolean, verdict string, at timestamp"
SEEN = "path string, size long, mtime long, at timestamp"
HANDLED = "path string, size long, mtime long, outcome string, tries int, at_ms long"
ACCEPTED, REFUSED, FOR_NOW = "ok", "never", "later"
#: The states of a group's paths; numbers are -1 where there is none.
_STATE = "paths array<struct<path: string, seen_size: long, seen_mtime: long, seen_until: long, size: long, mtime: long, due: long, verdict: string, tries: int>>"
#: Groups of paths unless the caller knows better.
GROUPS = 1 << 14
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Limits:
    """Milliseconds a file must stay the same, between tries and for which it is remembered; tries."""

    settle: int = 1000
    retry: int = 30_000
    remember: int = 7 * 24 * 3600 * 1000
    most_tries: int = 5


EMPTY = (-1, -1, -1, -1, -1, -1, "", 0)


def fire(state: tuple, until: int, limits: Limits) -> tuple[tuple, list[tuple]]:
    """The state after all timers up to ``until`` milliseconds, and what was handled: (size, mtime, outcome, tries, at).

    >>> fire((-1, -1, -1, 5, 7, 100, "later", 0), 100 + 4 * 30000, Limits())[1]
    [(5, 7, 'given up', 5, 120100)]
    """
    seen_size, seen_mtime, seen_until, size, mtime, due, verdict, tries = state
    out = []
    while 0 <= due <= until:
        tries += 1
        if verdict == FOR_NOW and tries < limits.most_tries:
            due += limits.retry
            continue
        outcome = {ACCEPTED: "accepted", FOR_NOW: "given up"}.get(verdict, "refused")
        out.append((size, mtime, outcome, tries, due))
        if seen_until < 0 or seen_until <= due + limits.remember:
            seen_size, seen_mtime, seen_until = size, mtime, due + limits.remember
        size = mtime = due = -1
        verdict, tries = "", 0
    if 0 <= seen_until <= until:
        seen_size = seen_mtime = seen_until = -1
    return (seen_size, seen_mtime, seen_until, size, mtime, due, verdict, tries), out


def observe(state: tuple, size: int, mtime: int, gone: bool, verdict: str, at: int, limits: Limits) -> tuple:
    """The state after one observation at ``at`` milliseconds; timers up to then have been fired."""
    seen = state[:3]
    if gone:
        return (*seen, -1, -1, -1, "", 0)
    if state[5] >= 0:  # it is waiting: a change starts the wait anew, the number of tries stays
        return (*state[:6], verdict, state[7]) if state[3:5] == (size, mtime) else (*seen, size, mtime, at + limits.settle, verdict, state[7])
    if seen[2] >= 0 and seen[:2] == (size, mtime) or seen[2] < 0 and mtime <= at - limits.remember:
        return state
    return (*seen, size, mtime, at + limits.settle, verdict, 0)


def _times(state: tuple) -> list[int]:
    """When the timers of a path are due."""
    return [x for x in (state[2], state[5]) if x >= 0]


def _earliest(paths: dict[str, tuple]) -> int:
    return min((x for state in paths.values() for x in _times(state)), default=-1)


class Intake(StatefulProcessor):
    """One group of paths: each path's rows in order, each after the path's timers that were due before it.

    The group's timer is that of the path that is due first.
    """

    def __init__(self, limits: Limits, schema: StructType):
        self.limits, self.schema = limits, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("path", self.schema)

    def _load(self) -> dict[str, tuple]:
        return {path: tuple(state) for path, *state in self.kept.get()[0]} if self.kept.exists() else {}

    def _save(self, timer: int, paths: dict[str, tuple]) -> None:
        left = {path: state for path, state in paths.items() if _times(state)}
        due = _earliest(left)
        if timer != due:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if due >= 0:
                self.handle.registerTimer(due)
        if left:
            self.kept.update(([(path, *state) for path, state in left.items()],))
        elif timer >= 0:
            self.kept.clear()

    @staticmethod
    def _rows(told: list[tuple]) -> Iterator[Row]:
        for path, size, mtime, outcome, tries, at in told:
            yield Row(path=path, size=size, mtime=mtime, outcome=outcome, tries=tries, at_ms=at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        paths = self._load()
        timer, told = _earliest(paths), []
        for r in sorted(rows, key=lambda r: (r.path, r.at, r.size or 0, r.mtime or 0)):
            at = round(r.at.timestamp() * 1000)
            state, out = fire(paths.get(r.path, EMPTY), at, self.limits)
            told += [(r.path, *x) for x in out]
            paths[r.path] = observe(state, r.size, r.mtime, bool(r.gone), r.verdict, at, self.limits)
        self._save(timer, paths)
        yield from self._rows(told)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        paths = self._load()
        timer, told = _earliest(paths), []
        # all rows up to the watermark have been seen, so the timers that follow from this one are due as well
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for path, before in paths.items():
            paths[path], out = fire(before, until, self.limits)
            told += [(path, *x) for x in out]
        self._save(timer, paths)
        yield from self._rows(told)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:  # noqa: N802, N803
        self._save(-1, {x["path"]: (x["size"], x["mtime"], round(x["at_us"] / 1000) + self.limits.remember, *EMPTY[3:]) for x in initialState.there})

    def close(self) -> None:
        pass


def intake(observed: DataFrame, there: DataFrame, limits: Limits = Limits(), late: str = "1 hour", groups: int = GROUPS) -> DataFrame:  # noqa: B008
    """``HANDLED`` of a stream of ``OBSERVED`` rows, where ``there`` (``SEEN``, a batch) was there before.

    Append mode; needs the RocksDB state store (:data:`STORE`). Rows more than ``late`` behind the
    latest are dropped. A path that is gone is forgotten while it waits. outcome is accepted, refused
    or given up, the last after ``most_tries`` refusals for now. Rows without a path or time are passed
    over. ``there`` has one row a path. ``groups`` makes no difference to the rows; a group should
    hold some ten to a hundred paths, and the number has to stay the same for as long as a checkpoint
    is used.
    """
    group = F.pmod(F.xxhash64("path"), F.lit(groups)).alias("group")
    told = observed.where("path is not null and at is not null").withWatermark("at", late)
    before = there.groupBy(group).agg(F.collect_list(F.struct("path", "size", "mtime", F.unix_micros("at").alias("at_us"))).alias("there"))
    return told.select(group, "*").groupBy("group").transformWithState(
        statefulProcessor=Intake(limits, _parse_datatype_string(_STATE)), outputStructType=_parse_datatype_string(HANDLED), outputMode="Append", timeMode="EventTime", initialState=before.groupBy("group")
    )


def replayed(spark: SparkSession, observed: DataFrame, there: DataFrame, limits: Limits = Limits(), late: str = "1 hour", groups: int = GROUPS) -> tuple[DataFrame, str]:  # noqa: B008
    """What :func:`intake` gives for all that a stream holds now, and the folder of its checkpoint."""
    from filewright.streaming.sink import committed, epochs

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        path, checkpoint = shared_path(spark, "intake-out"), shared_path(spark, "intake-checkpoint")
        epochs(intake(observed, there, limits, late, groups), path, checkpoint).awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return committed(spark, path, _parse_datatype_string(HANDLED)), checkpoint
