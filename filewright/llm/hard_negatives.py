"""Hard-negative mining with vantage-point trees over norm-augmented vectors.

Components become integers. Every row gets one more component that makes all rows equally long, and
an anchor's is zero: then the squared distance of an anchor and a row is a constant less twice their
inner product, higher scores are nearer rows, and a window of scores is an annulus of distances. A
block of rows is a vantage-point tree: a node splits its rows at the median distance to a vantage
point and keeps the least and greatest distance of each side. A traversal takes nodes nearest first,
passes over those whose distances miss the annulus, and ends when no node left can hold a row nearer
than the k that it has. Rows that the tree's bounds let through are told apart by whole scores alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import partial
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filewright.llm._shared import small_batches, stash
from filewright.llm.topk import big
from filewright.llm.vectors import blocks, matrix, numbered, usable

SCALE, EVERY, POSITIVES, K = 256, 50, 5, 3
#: A negative's score lies between LOW and HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows of a tree and anchors of an anchor block, on average, and rows of a leaf: they bound a task's memory.
BLOCK_ROWS, ANCHOR_ROWS, LEAF_ROWS = 4096, 8192, 256
#: Anchors whose scores are multiplied at once.
STRIP = 512
#: Rows with a component of this size or more stand in no tree: they are compared with every anchor.
WIDE = 1 << 22
#: Scores are compared exactly up to this size; larger ones count as that.
MOST = 10**37
LONG = 1 << 63


class Tree:
    """A vantage-point tree over integer rows, as arrays over its nodes; leaves hold ranges of ``order``."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.floats = rows.astype(np.float64)
        norms = (self.floats**2).sum(axis=1)
        self.longest = float(norms.max(initial=0))  # the squared length of every augmented row
        self.more = np.sqrt(self.longest - norms)  # the component that makes a row that long
        self.order = np.arange(len(rows))
        self.vantage: list[int] = []  # the row of an inner node, -1 in leaves
        self.span: list[tuple[int, int]] = []  # a node's range of order
        self.child: list[tuple[int, int]] = []  # nodes of its near and far half
        self.bound: list[tuple[float, float, float, float]] = []  # least and greatest distance to its vantage point in either half
        self._grow(0, len(rows))

    def _grow(self, low: int, high: int) -> int:
        node = len(self.vantage)
        self.vantage.append(-1)
        self.span.append((low, high))
        self.child.append((-1, -1))
        self.bound.append((0.0, 0.0, 0.0, 0.0))
        if high - low > LEAF_ROWS:
            some = self.order[low:high]
            # of two far apart rows one is a good vantage point: that farthest from the first row
            point = int(some[np.argmax(self._between(int(some[0]), some))])
            distance = self._between(point, some)
            half = len(some) // 2
            by = np.argpartition(distance, half)
            self.order[low:high], distance = some[by], distance[by]
            near, far = distance[:half], distance[half:]
            self.vantage[node] = point
            self.bound[node] = (float(near.min()), float(near.max()), float(far.min()), float(far.max()))
            self.child[node] = (self._grow(low, low + half), self._grow(low + half, high))
        return node

    def _between(self, row: int, others: np.ndarray) -> np.ndarray:
        product = self.floats[others] @ self.floats[row] + self.more[others] * self.more[row]
        return np.sqrt(np.maximum(0, 2 * (self.longest - product)))


class Annulus:
    """Whole scores from ``low`` to ``high``, None where there is no end."""

    def __init__(self, low: int | None = None, high: int | None = None):
        self.low, self.high = low, high

    @staticmethod
    def within(score: int, low: int, high: int) -> Annulus:
        """Scores of ``low`` to ``high`` hundredths of a score.

        >>> x = Annulus.within(7, 50, 95)
        >>> x.low, x.high
        (4, 6)
        """
        return Annulus(-(-low * score // 100), high * score // 100)

    def holds(self, score: int) -> bool:
        return (self.low is None or score >= self.low) and (self.high is None or score <= self.high)


class Strip:
    """Some anchors before a tree: the scores of all rows of a node are multiplied for all of them at once."""

    def __init__(self, tree: Tree, anchors: np.ndarray):
        self.tree, self.anchors = tree, anchors.astype(np.float64)
        self.leaves: dict[int, np.ndarray] = {}
        points = [v for v in tree.vantage if v >= 0]
        self.to_points = dict(zip([n for n, v in enumerate(tree.vantage) if v >= 0], (self.anchors @ tree.floats[points].T).T, strict=True))

    def scores(self, leaf: int) -> np.ndarray:
        found = self.leaves.get(leaf)
        if found is None:
            low, high = self.tree.span[leaf]
            found = self.leaves[leaf] = self.anchors @ self.tree.floats[self.tree.order[low:high]].T
        return found


class Seeker:
    """One anchor of a strip: its distances to all vantage points, shared by all its searches."""

    def __init__(self, strip: Strip, at: int):
        self.tree, self.strip, self.at = strip.tree, strip, at
        own = strip.anchors[at]
        self.both = float(own @ own) + self.tree.longest
        self.visited = 0
        self.slack = 1e-7 * math.sqrt(self.both + self.tree.longest) + 1e-6  # rounding never hides a row

    def distance(self, score: float) -> float:
        return math.sqrt(max(0.0, self.both - 2 * score))

    def first(self, k: int, annulus: Annulus, allowed: np.ndarray) -> tuple[list[int], list[int]]:
        """Rows and scores of the k highest scores in the annulus among ``allowed`` rows, ties by row."""
        tree, rows, scores = self.tree, np.empty(0, np.int64), np.empty(0)
        inner = 0.0 if annulus.high is None else self.distance(annulus.high) - self.slack
        limit = math.inf if annulus.low is None else self.distance(annulus.low) + self.slack
        least_score = -math.inf if annulus.low is None else annulus.low  # of the annulus, then of the k-th
        heap = [(inner, 0)]
        while heap:
            least, node = heappop(heap)
            if least > limit:
                break
            if tree.vantage[node] < 0:
                low, high = tree.span[node]
                self.visited += high - low
                score = self.strip.scores(node)[self.at]
                good = score >= least_score
                if annulus.high is not None:
                    good &= score <= annulus.high
                found = np.flatnonzero(good)
                if len(found):
                    at = tree.order[low + found]
                    may = allowed[at]
                    rows, scores = np.concatenate([rows, at[may]]), np.concatenate([scores, score[found[may]]])
                    order = np.lexsort((rows, -scores))[:k]
                    rows, scores = rows[order], scores[order]
                    if len(order) == k:
                        least_score = float(scores[-1])
                        limit = min(limit, self.distance(least_score) + self.slack)
                continue
            to = self.distance(float(self.strip.to_points[node][self.at]))
            near_least, near_most, far_least, far_most = tree.bound[node]
            for child, nearest, farthest in ((tree.child[node][0], near_least, near_most), (tree.child[node][1], far_least, far_most)):
                bound = max(least, to - farthest - self.slack, nearest - to - self.slack)
                if bound <= limit and to + farthest + self.slack >= inner:
                    heappush(heap, (bound, child))
        return rows.tolist(), scores.astype(np.int64).tolist()


class Block:
    """Rows in order of id: a tree of most, and exact numbers of the few wide ones."""

    def __init__(self, rows: pa.Table, scale: int):
        given = matrix(rows["v"], np.float64)
        with np.errstate(over="ignore"):
            scaled = np.floor(given * float(scale))
        wide = (np.abs(scaled) >= WIDE).any(axis=1) | (given.shape[1] > 1 << 8)
        self.place = np.flatnonzero(~wide)  # of the tree's rows
        self.tree = Tree(scaled[~wide].astype(np.int64))
        self.wide = {int(i): big(given[i], scale) for i in np.flatnonzero(wide)}
        self.given, self.scale = given, scale
        self.uids, self.labels = rows["uid"].to_numpy(), rows["label"].to_numpy()

    def searches(self, anchors: np.ndarray) -> Iterator[Callable[[int, Annulus, np.ndarray], list[tuple[int, int]]]]:
        """For each anchor what finds its first rows of an annulus among all allowed rows of the block."""
        exact = [big(x, self.scale) for x in anchors]
        plain = np.array([not len(x) or max(abs(y) for y in x) < WIDE for x in exact], bool)
        for start in range(0, len(anchors), STRIP):
            some = [n for n in range(start, min(start + STRIP, len(anchors))) if plain[n]]
            strip = Strip(self.tree, np.array([exact[n] for n in some], np.float64).reshape(len(some), self.given.shape[1]))
            place = {n: i for i, n in enumerate(some)}
            for n in range(start, min(start + STRIP, len(anchors))):
                # what no tree holds, or every row for a wide anchor
                aside = {i: int(v @ exact[n]) for i, v in self.wide.items()}
                if not plain[n]:
                    aside |= {int(i): int(big(self.given[i], self.scale) @ exact[n]) for i in self.place}
                yield partial(self._first, Seeker(strip, place[n]) if plain[n] and len(self.place) else None, aside)

    def _first(self, seek: Seeker | None, aside: dict[int, int], k: int, annulus: Annulus, allowed: np.ndarray) -> list[tuple[int, int]]:
        found = [(i, s) for i, s in aside.items() if allowed[i] and annulus.holds(s)]
        if seek:
            rows, scores = seek.first(k, annulus, allowed[self.place] if self.wide else allowed)
            found += zip(self.place[rows].tolist(), scores, strict=True)
        return sorted(found, key=lambda x: (-x[1], x[0]))[:k]


def _clamped(scores: list[int]) -> pa.Array:
    return pa.array([Decimal(min(max(x, -MOST), MOST)) for x in scores], pa.decimal128(38, 0))


def _in_block(anchors: pa.Table, rows: pa.Table, scale: int, k: int, within: tuple[int, int] | None) -> pa.Table:
    """The first k rows of one block for every anchor: of its label, or of other labels in each of its windows,
    which are ``within`` hundredths of a positive's score."""
    id_type = rows.schema.field("vec_id").type
    schema = pa.schema([("uid", pa.int64()), ("window", pa.int32()), ("row", pa.int64()), ("vec_id", id_type), ("score", pa.decimal128(38, 0))])
    if not len(anchors) or not len(rows):
        return schema.empty_table()
    rows = rows.sort_by([("vec_id", "ascending"), ("uid", "ascending")])  # ties go to the smaller id
    block, out = Block(rows, scale), ([], [], [], [])
    asked = matrix(anchors["v"], np.float64)
    bounds = anchors["bounds"].to_pylist() if within else [None] * len(anchors)
    for first, uid, label, spans in zip(block.searches(asked), anchors["uid"].to_pylist(), anchors["label"].to_pylist(), bounds, strict=True):
        same = block.labels == label
        if within:
            searches = [(x["window"], Annulus.within(int(x["score"]), *within), ~same) for x in spans]
        else:
            searches = [(0, Annulus(), same & (block.uids != uid))]
        for window, annulus, allowed in searches:
            for at, score in first(k, annulus, allowed):
                for column, value in zip(out, (uid, window, at, score), strict=True):
                    column.append(value)
    at = pa.array(out[2], pa.int64())
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), rows["uid"].take(at), rows["vec_id"].take(at), _clamped(out[3])], schema)


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, k: int = K, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``vectors(vec_id, label, embedding)``.

    Components become floor(scale * x); a row's score is its inner product with the anchor. Anchors
    are the rows whose vec_id is divisible by ``every``; positives are an anchor's best other rows of
    its label; each pair of them gets the best ``k`` rows of other labels whose score is ``low`` to
    ``high`` hundredths of the positive's, so none where that is below zero. Ties go to the smaller
    vec_id. Rows with a null label, a null vector or a null or non-finite component take no part, and
    rows of different lengths do not meet. Repeated rows are each other's positives. A null vec_id is
    no anchor and comes last among ties. Scores are exact up to 10**37 in size, larger ones count as
    that; what is beyond a long is returned as its end. An empty table gives no rows; other columns
    are ignored.
    """
    small_batches(vectors.sparkSession, 10_000)
    rows = numbered(vectors.select("vec_id", "embedding", "label"), "negatives-rows", "label").where(usable() & F.col("label").isNotNull())
    rows = rows.select("uid", "vec_id", "label", "dims", F.col("embedding").alias("v"))
    one = F.struct(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked"))
    n, asked = rows.agg(one.alias("x")).select("x.*").first()
    by_row, by_anchor = blocks(n, BLOCK_ROWS), blocks(asked, ANCHOR_ROWS)
    # every block of anchors meets every block of rows: a stated set of anchors against all rows
    row_block, anchor_block = F.pmod(F.xxhash64("uid"), F.lit(by_row)), F.pmod(F.xxhash64("uid"), F.lit(by_anchor))
    anchors = rows.where(F.col("vec_id") % every == 0)
    right = rows.select("dims", row_block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(by_anchor - 1)).cast("array<long>")).alias("q"), "uid", "vec_id", "label", "v")
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), "row"]

    def best(asking: DataFrame, k: int, within: tuple[int, int] | None) -> DataFrame:
        def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
            return _in_block(asked, rows, scale, k, within)

        row_blocks = F.explode(F.sequence(F.lit(0), F.lit(by_row - 1)).cast("array<long>")).alias("b")
        left = asking.select("dims", row_blocks, anchor_block.alias("q"), "uid", "vec_id", "label", "v", *(["bounds"] if within else []))
        found = left.groupBy("dims", "b", "q").cogroup(right.groupBy("dims", "b", "q")).applyInArrow(run, f"uid long, window int, row long, vec_id {id_type}, score decimal(38,0)")
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("uid", "window").orderBy(*order))).where(F.col("rank") <= k)

    near = stash(best(anchors, positives, None).select("uid", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # low <= 100 * score / positive's <= high in whole numbers; there is no such score below zero
    span = F.struct(F.col("rank").alias("window"), F.col("positive_score").alias("score"))
    windowed = near.where("positive_score >= 0").groupBy("uid").agg(F.collect_list(span).alias("bounds"))  # at most `positives` an anchor
    asking = stash(anchors.join(windowed, "uid"), "negatives-windows")
    found = best(asking, k, (low, high)).select("uid", F.col("window").alias("rank_of"), F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    told = found.join(near.withColumnRenamed("rank", "rank_of"), ["uid", "rank_of"]).join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    as_long = {c: F.least(F.greatest(c, F.lit(Decimal(-LONG))), F.lit(Decimal(LONG - 1))).cast("long").alias(c) for c in ("positive_score", "negative_score")}
    return told.select("anchor_id", "positive_id", "rank", "negative_id", as_long["positive_score"], as_long["negative_score"])
