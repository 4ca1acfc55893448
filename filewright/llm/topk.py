"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Components become integers. A block of rows is indexed as one posting list per dimension,
ordered by value and cut into segments. For a query, a posting's impact is what it adds to the score
over the least that its dimension can add, and a segment's impact is its highest. The segments of all
lists whose impact reaches a level are added up, for all queries of a strip in one product; what a row
may get from the others is bounded by the highest impact that is left in each dimension. Processing
goes down the levels and stops once that proves all but a few rows out, and every row not proved out
is rescored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filewright.llm._shared import small_batches
from filewright.llm.vectors import blocks, matrix, numbered, usable

SCALE, K, EVERY = 64, 20, 20
#: Rows of an indexed block and queries of a query block, on average: they bound a task's memory.
BLOCK_ROWS, QUERY_ROWS = 8192, 8192
#: Impact levels of a query as parts of its highest impact, in the order of processing, which stops
#: once all but one row in REST are proved out.
LEVELS, REST = (0.1, 0.03, 0.0), 8
#: Segments of a posting list, of about as many rows each, and queries that are processed at once.
SEGMENTS, STRIP = 4, 256
#: Scores are summed in single precision, which is exact for whole numbers below this.
EXACT = 1 << 24
#: Rows with a component of this size or more are in no posting list: they are rescored for every query.
WIDE = 1 << 31
LONG = 1 << 63
#: Scores up to this size are ranked as decimals, larger ones by their digits as well.
MOST = 10**37
_TURNED = str.maketrans("0123456789", "9876543210")


class Index:
    """Posting lists of one block of integer rows, each ordered by value and cut into segments."""

    def __init__(self, rows: np.ndarray):
        self.rows, (self.n, self.dims) = rows, rows.shape
        self.low, self.high = rows.min(axis=0), rows.max(axis=0)
        self.span = self.high - self.low
        above = (rows - self.low).T  # per dimension, how far each row is above the least value
        ordered = np.sort(above, axis=1)
        # equal values lie in one segment, so some may be empty
        begins = ordered[:, [self.n * i // SEGMENTS for i in range(1, SEGMENTS)]]
        place = (above[:, None, :] >= begins[:, :, None]).sum(axis=1, dtype=np.int8)
        inside = place[:, None, :] == np.arange(SEGMENTS)[:, None]
        self.filled = inside.any(axis=2)
        self.least = np.where(inside, above[:, None, :], self.span[:, None, None]).min(axis=2)
        self.best = np.where(inside, above[:, None, :], 0).max(axis=2)
        # what each segment holds of each row, and whether it holds it
        self.lists = np.concatenate([np.where(inside, above[:, None, :], 0), inside]).reshape(-1, self.n).astype(np.float32)
        self.most, self.floats = np.abs(rows).max(axis=0), rows.astype(np.float64)

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products; in floating point where all sums are whole numbers below 2**53."""
        most = int(np.abs(query).astype(object) @ self.most.astype(object))
        if most < 1 << 53:
            return (self.floats[at] @ query.astype(np.float64)).astype(np.int64)
        if most < LONG:
            return self.rows[at] @ query
        return self.rows[at].astype(object) @ query.astype(object)

    def possible(self, query: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """Rows that may be among the k best; rows at ``own`` are none of the candidates."""
        return next(self.each_possible(query[None, :], k, [own]))

    def each_possible(self, queries: np.ndarray, k: int, own: list[np.ndarray]) -> Iterator[np.ndarray]:
        """:meth:`possible` of each query, a strip of queries at a time."""
        for at in range(0, len(queries), STRIP):
            strip, owned = queries[at : at + STRIP], own[at : at + STRIP]
            found: list = [None] * len(strip)
            peaks = np.abs(strip).astype(np.float64) * self.span
            left = np.flatnonzero((peaks > 0).any(axis=1) & (peaks.sum(axis=1) < EXACT // 2) & np.array([self.n - len(x) > 2 * k for x in owned], bool))
            for n in np.setdiff1d(np.arange(len(strip)), left):
                found[n] = np.setdiff1d(np.arange(self.n), owned[n])
            for part in LEVELS:
                if len(left):
                    rows = self._open(strip[left], k, [owned[n] for n in left], part)
                    for n, x in zip(left, rows, strict=True):
                        found[n] = x if not part or len(x) * REST <= self.n else None
                    left = np.array([n for n in left if found[n] is None], int)
            yield from found

    def _open(self, queries: np.ndarray, k: int, own: list[np.ndarray], part: float) -> list[np.ndarray]:
        """The rows that are not proved out once all segments down to ``part`` of a query's highest impact are added."""
        weight, up = np.abs(queries)[:, :, None], (queries > 0)[:, :, None]
        impact = weight * np.where(up, self.best, self.span[:, None] - self.least) * self.filled
        met = impact >= np.ceil(impact.max(axis=(1, 2), keepdims=True) * part)
        rest = np.where(met, 0, impact).max(axis=2)  # the highest impact that is left in a dimension
        # a row has its impact where its segment is met and the highest that is left elsewhere
        by_value = np.where(met, np.where(up, weight, -weight), 0)
        by_place = np.where(met, np.where(up, 0, weight * self.span[:, None]) - rest[:, :, None], 0)
        most = np.concatenate([by_value, by_place], axis=1).reshape(len(queries), -1).astype(np.float32) @ self.lists
        most += rest.sum(axis=1, dtype=np.int64).astype(np.float32)[:, None]
        for n, rows in enumerate(own):
            most[n, rows] = -np.inf
        # the k-th best whole score of the rows that lead so far is a bound for the k-th best of all
        lead = np.argpartition(most, -2 * k, axis=1)[:, -2 * k :]
        least = np.where(queries > 0, self.low, self.high)  # what every row has at least
        whole = np.einsum("nkd,nd->nk", self.floats[lead] - least[:, None, :], queries.astype(np.float64))
        kth = np.partition(whole, -k, axis=1)[:, -k]
        return [np.flatnonzero(x >= y) for x, y in zip(most, kth.astype(np.float32), strict=True)]


def whole(vectors: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers floor(scale * x) of rows, and which rows are wide; those are zero in the first.

    >>> whole(np.array([[0.5, -0.01], [1e300, 0.0]]), 64)[0].tolist()
    [[32, -1], [0, 0]]
    """
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * float(scale))
    wide = (np.abs(scaled) >= WIDE).any(axis=1)
    return np.where(wide[:, None], 0, scaled).astype(np.int64), wide


def big(vector: np.ndarray, scale: int) -> np.ndarray:
    """One row as exact whole numbers of any size."""
    return np.array([scale * int(x) if abs(x) >= 1 << 60 else math.floor(scale * x) for x in vector.tolist()], object)


def digits(score: int) -> str:
    """What orders scores beyond MOST as text.

    >>> digits(5), digits(10**37 + 1) < digits(10**38), digits(-(10**37) - 1) > digits(-(10**38))
    ('', True, True)
    """
    if abs(score) <= MOST:
        return ""
    text = f"{len(str(abs(score))):06d}{abs(score)}"
    return text if score > 0 else text.translate(_TURNED)


def _search(queries: pa.Table, rows: pa.Table, k: int, scale: int) -> pa.Table:
    schema = pa.schema([("uid", pa.int64()), ("query_id", queries.schema.field("vec_id").type), ("vec_id", rows.schema.field("vec_id").type), ("score", pa.decimal128(38, 0)), ("digits", pa.string()), ("row", pa.int64())])
    if not len(queries) or not len(rows):
        return schema.empty_table()
    rows = rows.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
    given, asked = matrix(rows["v"], np.float64), matrix(queries["v"], np.float64)
    (values, wide), (wanted, far) = whole(given, scale), whole(asked, scale)
    index, beyond = Index(values), {int(i): big(given[i], scale) for i in np.flatnonzero(wide)}
    uids = rows["uid"].to_numpy()
    by_uid = np.argsort(uids, kind="stable")
    out: list[list] = [[], [], []]
    at = np.minimum(np.searchsorted(uids, queries["uid"].to_numpy(), sorter=by_uid), len(uids) - 1)
    own = [by_uid[x : x + 1] if uids[by_uid[x]] == uid else by_uid[:0] for x, uid in zip(at, queries["uid"].to_numpy(), strict=True)]
    # wide rows are in no list; what a wide query gets is computed below
    passed = [np.union1d(x, np.flatnonzero(wide)) for x in own] if beyond else own
    for n, (query, maybe) in enumerate(zip(wanted, index.each_possible(wanted, k, passed), strict=True)):
        if far[n] or beyond:
            exact = big(asked[n], scale)
            found = np.setdiff1d(np.arange(len(values)), own[n]) if far[n] else np.union1d(maybe, np.setdiff1d(np.flatnonzero(wide), own[n]))
            score = values[found].astype(object) @ exact if far[n] else index.scores(found, query).astype(object)
            for place in np.flatnonzero(wide[found]):
                score[place] = int(beyond[int(found[place])] @ exact)
        else:
            found = maybe
            score = index.scores(found, query)
        best = np.array(sorted(range(len(score)), key=lambda i: -score[i])[:k], int) if score.dtype == object else np.argsort(-score, kind="stable")[:k]
        out[0].append(np.full(len(best), n))
        out[1].append(found[best])  # rows are in order of vec_id: ties go to the smaller
        out[2] += map(int, score[best])
    which, row = (np.concatenate(x) for x in out[:2])
    score = pa.array([Decimal(min(max(x, -MOST), MOST)) for x in out[2]], pa.decimal128(38, 0))
    beyond_most = pa.array(map(digits, out[2]), pa.string())
    return pa.table([queries["uid"].take(which), queries["vec_id"].take(which), rows["vec_id"].take(row), score, beyond_most, rows["uid"].take(row)], schema)


def search(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows of every query row.

    Queries are the rows whose vec_id is divisible by ``every``; components become
    floor(scale * x). Null vectors and vectors with a null or non-finite component take no part, nor
    do rows of another length than the query's. A null vec_id is a candidate, last among ties, and
    no query. Ties go to the smaller vec_id; repeated rows are candidates of each other; other
    columns are ignored. A score beyond the range of a long is returned as the end of that range.
    """
    small_batches(vectors.sparkSession, 10_000)
    rows = numbered(vectors, "topk-rows").where(usable()).select("uid", "vec_id", "dims", F.col("embedding").alias("v"))
    asked = rows.where(F.col("vec_id") % every == 0)
    one = F.struct(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked"))
    n, queries = rows.agg(one.alias("x")).select("x.*").first()
    by_row, by_query = blocks(n, BLOCK_ROWS), blocks(queries, QUERY_ROWS)
    # every block of queries meets every block of rows: a stated query set against all rows
    row_block, query_block = F.pmod(F.xxhash64("uid"), F.lit(by_row)), F.pmod(F.xxhash64("uid"), F.lit(by_query))
    left = asked.select("dims", F.explode(F.sequence(F.lit(0), F.lit(by_row - 1)).cast("array<long>")).alias("b"), query_block.alias("q"), "uid", "vec_id", "v")
    right = rows.select("dims", row_block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(by_query - 1)).cast("array<long>")).alias("q"), "uid", "vec_id", "v")
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        return _search(queries, rows, k, scale)

    found = left.groupBy("dims", "b", "q").cogroup(right.groupBy("dims", "b", "q")).applyInArrow(run, f"uid long, query_id {kind}, vec_id {kind}, score decimal(38,0), digits string, row long")
    as_long = F.least(F.greatest("score", F.lit(Decimal(-LONG))), F.lit(Decimal(LONG - 1))).cast("long")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), F.desc("digits"), F.asc_nulls_last("vec_id"), "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", as_long.alias("score"))
