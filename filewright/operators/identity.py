"""Which item is which file after a history of renames: identity follows the file.

A path has one occupant from one move away from it to the next. Its first occupant gives such a span
its identity: the catalogue's item if the span is the path's first one, else the file that came by
the span's first rename; files that are moved to a taken path merge into its occupant. So each span
points to at most one earlier span, the one that its first rename ended, and pointer jumping along
these dated edges finds the origin of every span in as many rounds as the logarithm of the longest
chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.operators.sequences import running_before
from filewright.session import written


def origins(spans: DataFrame) -> DataFrame:
    """``(seq, origin)``: the end of the chain of each row of ``spans(seq, before)``; its own seq where before is null."""
    open_ = written(spans.select("seq", F.coalesce("before", "seq").alias("to"), F.col("before").isNull().alias("ends")), "identity-chains")
    done = open_.where("ends").select("seq", F.col("to").alias("origin"))
    left = open_.where("not ends").drop("ends")
    while not left.isEmpty():
        # what points to a span whose origin is known is done; everything else doubles its reach
        jumps = done.select(F.col("seq").alias("to"), F.col("origin").alias("beyond"), F.lit(True).alias("last"))
        jumps = jumps.unionByName(left.select(F.col("seq").alias("to"), F.col("to").alias("beyond"), F.lit(False).alias("last")))
        jumped = written(left.join(jumps, "to").select("seq", F.col("beyond").alias("to"), "last"), "identity-chains")
        done = done.unionByName(jumped.where("last").select("seq", F.col("to").alias("origin")))
        left = jumped.where("not last").drop("last")
    return done


def followed(catalogue: DataFrame, renames: DataFrame, block: int = 1 << 16) -> DataFrame:
    """``(path, item, born, status)``: the occupant of every taken path after all renames, and the items that are gone.

    ``catalogue(item, path)`` has unique paths; ``renames(seq, source, target)`` a unique seq, by which
    they are ordered. What is moved to a taken path becomes that path's item, and the item that it was
    is ``missing``, at its first path. A rename of a path that no file is known to have begins an item
    of its own: item is null and born its seq. A rename to the same path has no effect, nor have null
    paths. An empty catalogue or history is allowed; other columns are ignored. ``block`` renames
    are counted at once, so that a path of any number of renames is no task of its own.
    """
    moves = renames.select("seq", "source", "target").where("source <> target")
    touches = moves.select("seq", F.explode(F.array(F.struct(F.col("source").alias("path"), F.lit(1).alias("away")), F.struct(F.col("target").alias("path"), F.lit(0).alias("away")))).alias("t")).select("seq", "t.*")
    dated = running_before(touches, ["path"], "seq", "away", block).withColumnRenamed("before", "span")
    known = catalogue.where("path is not null").select("path", "item")
    begun = dated.groupBy("path", "span").agg(F.min(F.when(F.col("away") == 0, F.col("seq"))).alias("first"), F.max(F.when(F.col("away") == 1, F.col("seq"))).alias("ended"))
    spans = begun.join(known.withColumn("span", F.lit(0).cast("long")).withColumn("listed", F.lit(True)), ["path", "span"], "left")
    spans = written(spans.withColumn("before", F.when(F.col("listed").isNull(), F.col("first"))), "identity-spans")

    chains = spans.where("ended is not null").select(F.col("ended").alias("seq"), "before")
    roots = origins(chains).join(spans.where("ended is not null").select(F.col("ended").alias("origin"), F.col("item").alias("root_item"), F.col("listed").alias("root_listed")), "origin")
    named = roots.select(F.col("seq").alias("before"), "root_item", F.when(F.col("root_listed").isNull(), F.col("origin")).alias("root_born"))
    ends = spans.where("ended is null").join(named, "before", "left")
    taken = ends.select("path", F.coalesce("item", "root_item").alias("item"), F.col("root_born").alias("born"))
    untouched = known.join(begun.select("path").distinct(), "path", "left_anti").select("path", "item", F.lit(None).cast("long").alias("born"))
    live = taken.select("path", "item", F.col("born").cast("long").alias("born")).unionByName(untouched)
    gone = known.join(live.where("item is not null").select("item").distinct(), "item", "left_anti").select("path", "item", F.lit(None).cast("long").alias("born"))
    return live.withColumn("status", F.lit("live")).unionByName(gone.withColumn("status", F.lit("missing")))
