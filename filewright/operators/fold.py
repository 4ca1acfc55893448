"""Ordered folds: a state machine over the rows of each key, in order, in bounded memory.

For histories whose every step depends on the state before it, which no window frame expresses.
Rows are dealt by key and sorted within partitions, so a key of any number of rows passes its task
batch by batch; only the state is held, never the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


class Steps(Protocol):
    """The state of one key."""

    def add(self, row: dict) -> Iterable[tuple]:
        """Take the next row; gives rows of the result, without the key."""

    def end(self) -> Iterable[tuple]:
        """What the key gives after its last row."""


def folded(rows: DataFrame, by: list[str], order: list[str], start: Callable[[], Steps], schema: str) -> DataFrame:
    """``(*by, *schema)``: what ``start()`` of each key gives over its rows in ``order``, which ends in a unique column."""
    keys = rows.select(*by).schema
    listed = _parse_datatype_string(schema)
    out = StructType([*keys.fields, *listed.fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, steps, made = None, None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) or [[] for _ in arrow]
            built = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            made.clear()
            return built

        for rows in batches:
            for row in rows.to_pylist():
                now = tuple(row[c] for c in by)
                if steps is None or now != key:
                    if steps is not None:
                        made.extend((*key, *x) for x in steps.end())
                    key, steps = now, start()
                made.extend((*key, *x) for x in steps.add(row))
            if made:
                yield batch()
        if steps is not None:
            made.extend((*key, *x) for x in steps.end())
        yield batch()

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, out)
