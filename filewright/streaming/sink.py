"""A sink that is idempotent by epoch, and the recovery of operations that were cut off.

Every epoch has a folder of its own that a replay overwrites, so it makes no difference whether a
query is killed before, during or after a write whose epoch it had not yet committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def epochs(stream: DataFrame, path: str, checkpoint: str, after=None) -> StreamingQuery:
    """Start writing what ``stream`` holds now, an epoch a folder; ``after(epoch)`` runs after each write."""

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        if after is not None:
            after(epoch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all epochs."""
    return spark.read.schema(schema).parquet(f"{path}/epoch=*")


def recovered(journal: DataFrame, found: DataFrame) -> DataFrame:
    """``(seq, plan_id, item_id, op, status)``: the rows that a crash has left ``started``, settled by what files there are.

    ``journal(seq, plan_id, item_id, op, status, mark)`` holds moves into quarantine and back;
    ``found(item_id, place, mark)`` the files that are there, place being ``origin`` or ``quarantine``;
    the empty file that a move reserves has no mark. Files count where their mark is that of the
    journal. A move whose file is in its target is ``done``; one whose file is where it was, with
    nothing but a reservation in the target, is ``reverted`` for a quarantine and ``failed`` for a
    restore; all others stay ``started``, and so does a row without a mark. Recovering twice changes
    nothing. Rows of other states are passed over, as are other columns; found has one row an item
    and place.
    """
    left = journal.where((F.col("status") == "started") & F.col("op").isin("quarantine", "restore"))
    sides = found.groupBy("item_id").agg(*(F.max(F.when(F.col("place") == place, F.col("mark"))).alias(place) for place in ("origin", "quarantine")))
    both = left.join(sides, "item_id", "left")
    restores = F.col("op") == "restore"
    target, source = (F.when(restores, F.col(a)).otherwise(F.col(b)) for a, b in (("origin", "quarantine"), ("quarantine", "origin")))
    # a target that is there without a mark is a reservation
    status = F.when(target == F.col("mark"), "done").when((source == F.col("mark")) & target.isNull(), F.when(restores, "failed").otherwise("reverted")).otherwise("started")
    return both.select("seq", "plan_id", "item_id", "op", status.alias("status"))
