"""Exact copies and same-text copies, each with the one to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.functions.text import looks_like_copy

SAME_TEXT_CHARS = 200


def keeper_order(name: Column, first_seen: Column, path: Column) -> Column:
    """What ranks the copies of one content: first seen, then no copy mark in the name, then path."""
    return F.struct(first_seen.alias("first_seen"), looks_like_copy(name).alias("copy"), path.alias("path"))


def copies(items: DataFrame, content: str, key: str, order: Column) -> DataFrame:
    """``(key, keeper, n_copies)`` of every item that is not the keeper of its content.

    The keeper is found with an aggregate, whose partial results keep a content that a third of
    all items share off any one task, and joined back; the join splits large partitions.
    """
    groups = items.where(F.col(content).isNotNull()).groupBy(content).agg(F.min_by(key, order).alias("keeper"), F.count("*").alias("n_copies")).where("n_copies > 1")
    return items.join(groups, content).where(F.col(key) != F.col("keeper")).select(key, "keeper", "n_copies")


def exact(items: DataFrame, key: str = "id") -> DataFrame:
    """Copies by ``sha256``; items without a hash are nobody's copy."""
    order = F.struct(keeper_order(F.col("name"), F.col("first_seen_at"), F.col("path")).alias("by"), F.col(key).alias("key"))
    return copies(items, "sha256", key, order)


def same_text(items: DataFrame, key: str = "id") -> DataFrame:
    """Copies by ``text`` of at least 200 characters whose bytes differ from the keeper's."""
    order = F.struct(keeper_order(F.col("name"), F.col("first_seen_at"), F.col("path")).alias("by"), F.col(key).alias("key"))
    long = items.where(F.length("text") >= SAME_TEXT_CHARS).withColumn("text_hash", F.sha2("text", 256))
    found = copies(long, "text_hash", key, order)
    hashes = items.select(F.col(key).alias("keeper"), F.col("sha256").alias("keeper_sha"))
    return found.join(items.select(key, "sha256"), key).join(hashes, "keeper").where(~F.col("sha256").eqNullSafe(F.col("keeper_sha"))).select(key, "keeper", "n_copies")


def keeper_survives(selected: DataFrame, items: DataFrame) -> DataFrame:
    """``(id, safe)``: whether a live copy outside ``selected`` has the content of each selected item."""
    outside = items.join(selected, "id", "left_anti").select("sha256").where("sha256 is not null").distinct().withColumn("safe", F.lit(True))
    return selected.join(items, "id").join(outside, "sha256", "left").select("id", F.coalesce("safe", F.lit(False)).alias("safe"))
