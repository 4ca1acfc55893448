"""What the training-data operators share: stashed tables, bounded Arrow batches, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold on its way to a Python worker; they bound memory
#: and drop nothing. A single longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 256, 64 << 20
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is unset and Spark runs on this machine alone, as in tests, a
    temporary folder is used; on a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _local[context.applicationId]


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._stashed = path
    return made


def discard(*stashed: DataFrame) -> None:
    """Delete what :func:`stash` has written, once no frame that is still to be run reads it."""
    for df in stashed:
        path = getattr(df, "_stashed", None)
        if path:
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of this session in rows and bytes, unless its user chose smaller ones.

    Plans are run after the operator has returned, so the bounds stay set in the session.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def _directed(edges: DataFrame) -> DataFrame:
    """Larger node first, no loops, no repeats."""
    return edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of ``edges(u long, v long)`` as ``(node, component)``.

    component is the smallest node reachable. Alternates large-star and small-star steps until
    nothing moves; every step is an aggregate and a join whose partial sums absorb hubs. Nodes
    without an edge to another node are not returned.
    """
    now = stash(_directed(edges), f"{label}-edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour of u hangs on u's least neighbour
        large = _directed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u and its smaller neighbours hang on the least of them
        moved = large.join(small, "u")
        before, now = now, stash(
            _directed(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))),
            f"{label}-edges",
        )
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    leaves = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = leaves.select(F.col("component").alias("node"), "component").distinct()
    return leaves.unionByName(roots)
