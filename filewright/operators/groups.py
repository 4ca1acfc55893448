"""Groups of files and their members: what has changed between two versions, and a nested view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filewright.operators.sequences import micros


def changes(old: DataFrame, new: DataFrame, scope: DataFrame) -> DataFrame:
    """``(item, change, group_id, keeper, level)``: the feed that makes ``old`` into ``new``, from one full outer join.

    ``old`` and ``new`` are ``(item, group_id, keeper, level)`` with one row an item; ``scope(item,
    fresh)`` lists the items that this run has looked at. An item of old that is in no group any more is
    ``removed``; one of new is ``added``, or ``changed`` if anything differs, unless it has changed since
    it was looked at (not fresh): that is ``stale``, and stays as it was. Items outside the scope and
    members that are as before give no row.
    """
    told = ["group_id", "keeper", "level"]
    was, now = (side.select("item", F.struct(*told).alias(name)) for side, name in ((old, "was"), (new, "now")))
    both = was.join(now, "item", "full_outer").join(scope.select("item", "fresh"), "item")
    kind = F.when(F.col("now").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), F.lit(None)).when(~F.coalesce("fresh", F.lit(False)), "stale").when(F.col("was").isNull(), "added").otherwise("changed")
    kept = F.coalesce("now", "was")
    return both.withColumn("change", kind).where("change is not null").select("item", "change", *(kept[c].alias(c) for c in told))


def new_groups(members: DataFrame, asked: DataFrame) -> DataFrame:
    """``(group_id)`` of groups that have not been asked about yet."""
    return members.select("group_id").distinct().join(asked.select("group_id"), "group_id", "left_anti")


def nested(members: DataFrame, items: DataFrame, live: Column, most: int = 1000) -> DataFrame:
    """``(group_id, page, keeper, at, level, n, span_seconds, members)``: groups with their live members, newest first.

    ``items(item, name, bytes, mtime)``, with what ``live`` needs, is joined by item. A group without its
    keeper or without other members is left out. members lists ``(item, name, bytes, level)`` by time, at
    most ``most`` to a page, so that a group of any size is no single row; n and span count the group.
    """
    rows = members.select("item", "group_id", "keeper", "level").join(items.where(live).select("item", "name", "bytes", "mtime"), "item")
    is_keeper = F.col("item") == F.col("keeper")
    whole = rows.groupBy("group_id").agg(
        F.max_by(F.struct("item", "level", "mtime"), F.when(is_keeper, F.col("mtime"))).alias("k"), F.count_if(~is_keeper).alias("n"),
        F.round((F.max(micros("mtime")) - F.min(micros("mtime"))) / 1_000_000).cast("long").alias("span_seconds"),
    ).where("n > 0 and k is not null")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("mtime"), "item"))
    paged = rows.where(~is_keeper).withColumn("__n", place).withColumn("page", F.floor((F.col("__n") - 1) / most).cast("int"))
    listed = paged.groupBy("group_id", "page").agg(F.array_sort(F.collect_list(F.struct("__n", "item", "name", "bytes", "level"))).alias("m"))  # at most `most` rows
    out = F.transform("m", lambda x: F.struct(*(x[c].alias(c) for c in ("item", "name", "bytes", "level"))))
    return listed.join(whole, "group_id").select("group_id", "page", F.col("k.item").alias("keeper"), F.col("k.mtime").alias("at"), F.when(F.col("k.level") == "same", "same").otherwise("similar").alias("level"), "n", "span_seconds", out.alias("members"))
