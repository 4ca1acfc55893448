"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Rows are rotated to the principal axes of all vectors. A tile pair accumulates the products of the
axes in steps, the leading axes first. After each step Cauchy-Schwarz bounds what is left by the
product of the suffix norms, and pairs that cannot reach the threshold any more are dropped; only
pairs that pass the last step get their cosine in the given axes. Tiles are ranges of the first
axis, so tile pairs too far apart on it are never formed. A tile pair returns link counts and a
spanning forest of its links, never the links themselves.

Every row goes to each tile near its own, so the shuffle is rows times tiles; the tiles near one
form a range of numbers, so the driver holds a few numbers a tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.llm._shared import components, small_batches, stash
from filewright.llm.vectors import blocks, matrix, numbered, usable

THRESHOLD = 0.9
#: Distinct vectors of a tile on average, rows compared at once, and the parts of the axes after
#: which the bound is tried.
TILE_ROWS, STRIP, STEPS = 8192, 512, (0.25, 0.5, 0.75, 1.0)
#: Slack of the bound, which is computed in single precision.
SLACK = 1e-4


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Columns are the eigenvectors of the second moments of ``vectors(unit)``, largest first.

    Only dims * dims sums reach the driver.
    """

    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            unit = matrix(pa.chunked_array([batch.column(0)]), np.float64)
            total += unit.T @ unit
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "s"])

    sums = vectors.select("unit").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    moment = np.zeros((dims, dims))
    moment[sums.i, sums.j] = moment[sums.j, sums.i] = sums.s
    return np.linalg.eigh(moment)[1][:, ::-1].copy()


def _merge(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Union the ends of the links (x, y) under the smaller root."""
    while len(x):
        rx, ry = root[x], root[y]
        apart = rx != ry
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root != root[root]).any():
            root[:] = root[root]


class Rotated:
    """Unit rows in the order of the principal axes, with the norms of what follows each step."""

    def __init__(self, unit: np.ndarray, axes: np.ndarray):
        self.rows = unit @ axes
        self.cuts = sorted({max(1, round(x * axes.shape[1])) for x in STEPS})
        left = np.maximum(0, 1 - np.cumsum(self.rows**2, axis=1))
        self.suffix = [np.sqrt(left[:, c - 1]) for c in self.cuts]

    def leading(self) -> np.ndarray:
        """The coordinates of the first step and, as one more, the first suffix norm."""
        return np.concatenate([self.rows[:, : self.cuts[0]], self.suffix[0][:, None]], axis=1).astype(np.float32)


def _reaching(one: Rotated, two: Rotated, x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that can reach the threshold after each further step of the axes."""
    begin, total = 0, np.zeros(len(x))
    for cut, su, sv in zip(one.cuts, one.suffix, two.suffix, strict=True):
        total += np.einsum("nd,nd->n", one.rows[x, begin:cut], two.rows[y, begin:cut])
        may = total + su[x] * sv[y] >= threshold - SLACK
        x, y, total, begin = x[may], y[may], total[may], cut
    return x, y


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float):
    """Strips of index pairs of unit rows of a and b whose cosine reaches the threshold."""
    one, two = Rotated(a, axes), Rotated(b, axes)
    fa, fb = one.leading(), two.leading().T.copy()
    for at in range(0, len(a), STRIP):
        may = fa[at : at + STRIP] @ fb >= threshold - SLACK
        i, j = np.nonzero(may)
        for part in range(0, len(i), 1 << 16):
            x, y = _reaching(one, two, i[part : part + (1 << 16)] + at, j[part : part + (1 << 16)], threshold)
            reach = np.einsum("nd,nd->n", a[x], b[y]) >= threshold
            yield x[reach], y[reach]


def _compare(group: pa.Table, axes: np.ndarray, threshold: float) -> pa.Table:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])
    sides = group["tile"].to_numpy()
    first, last = int(group["i"][0].as_py()), int(group["j"][0].as_py())
    one, two = np.flatnonzero(sides == first), np.flatnonzero(sides == last)
    if not len(one) or not len(two):
        return schema.empty_table()
    unit, node, copies = matrix(group["unit"], np.float64), group["class"].to_numpy(), group["copies"].to_numpy()
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))
    for x, y in linked(unit[one], unit[two], axes, threshold):
        x, y = one[x], two[y]
        if first == last:
            x, y = x[x != y], y[x != y]
            np.add.at(links, x, copies[y])
        else:
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
        _merge(root, x, y)
    moved, counted = root != np.arange(len(root)), links > 0
    u = np.concatenate([node[moved], node[counted]])
    v = pa.array(np.concatenate([node[root[moved]], np.zeros(counted.sum(), np.int64)]), mask=np.arange(len(u)) >= moved.sum())
    return pa.table([pa.array(u), v, pa.array(np.concatenate([np.zeros(moved.sum(), np.int64), links[counted]]))], schema)


def _compared(classes: DataFrame, dims: int, threshold: float) -> DataFrame:
    """``(u, v, links)``: forest edges, and link counts of class u where v is null."""
    axes = principal_axes(classes, dims)
    first = F.aggregate(F.zip_with("unit", F.array(*map(F.lit, axes[:, 0].tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    placed = classes.withColumn("p", first)
    tiles = blocks(placed.count(), TILE_ROWS)
    cuts = placed.approxQuantile("p", [k / tiles for k in range(1, tiles)], 0.1 / tiles) if tiles > 1 else []
    # equal values of the first axis share a range, so every range is also dealt over slots
    edges = classes.sparkSession.sparkContext.broadcast(np.unique(cuts))  # a number a tile

    @F.pandas_udf("int")
    def span(p: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges.value, p, "right"), dtype="int32")

    placed = stash(placed.withColumn("range", span("p")), "embed-placed")
    ranges = placed.groupBy("range").agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high")).orderBy("range").collect()
    slots = np.array([blocks(r["n"], 2 * TILE_ROWS) for r in ranges], int)
    ends, low, high = np.cumsum(slots), np.array([r["low"] for r in ranges]), np.array([r["high"] for r in ranges])
    far = (2 - 2 * threshold) ** 0.5 + 1e-9  # unit vectors this far apart on one axis cannot reach it
    first, last = np.searchsorted(high, low - far), np.searchsorted(low, high + far, "right") - 1
    plan = [(r["range"], int(ends[k] - slots[k]), int(slots[k]), int(ends[first[k]] - slots[first[k]]), int(ends[last[k]]) - 1) for k, r in enumerate(ranges)]
    known = F.broadcast(classes.sparkSession.createDataFrame(plan, "range int, start int, slots int, first int, last int"))  # a row a tile
    tile = (F.col("start") + F.pmod(F.xxhash64("class"), F.col("slots"))).cast("int")
    met = placed.join(known, "range").select(tile.alias("tile"), F.explode(F.sequence("first", "last")).alias("other"), "class", "copies", "unit")
    paired = met.select(F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "class", "copies", "unit")

    def run(group: pa.Table) -> pa.Table:
        return _compare(group, axes, threshold)

    return stash(paired.groupBy("i", "j").applyInArrow(run, "u long, v long, links long"), "embed-links")


def dedup(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing,
    nor do vectors of different lengths; any other finite vector takes part, however large or small. Equal vectors become one class first, so a group of
    copies costs one comparison. Repeated vec_ids are rows of their own; a null vec_id is kept
    and names a component only if it has no other; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark, 10_000)
    rows = numbered(vectors, "embed-rows")
    # scaled by its largest component first, so that no square overflows or vanishes
    most = F.array_max(F.transform("embedding", F.abs))
    scaled = F.transform("embedding", lambda x: x / F.col("most"))
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform("scaled", lambda x: x / F.col("norm"))
    good = rows.where(usable()).withColumn("most", most).where("most > 0")
    distinct = good.groupBy("embedding").agg(F.min("uid").alias("class"), F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("dims").alias("dims"), F.first("most").alias("most"))
    classes = stash(distinct.withColumn("scaled", scaled).withColumn("norm", norm).withColumn("unit", unit).drop("scaled", "norm", "most"), "embed-classes")
    found = [_compared(classes.where(F.col("dims") == d).select("class", "copies", "unit"), d, threshold) for (d,) in classes.select("dims").distinct().collect()]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    degree = links.where("v is null").groupBy(F.col("u").alias("class")).agg(F.sum("links").alias("links"))
    joined = components(links.where("v is not null").select("u", "v"), "embed").withColumnRenamed("node", "class")
    own = classes.select("class", "least", "copies", "embedding").join(degree, "class", "left").join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = own.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = own.join(named, "component").select("embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    told = rows.join(labelled, "embedding", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return told.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
