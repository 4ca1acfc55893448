"""Aggregates: call statistics, phrases and their groups, text search."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def call_stats(calls: DataFrame, ok: Column, millis: Column, digits: int = 3) -> DataFrame:
    """One row: all calls, good and failed ones, and the mean time of the good ones."""
    return calls.agg(F.count("*").alias("n_calls"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.round(F.avg(F.when(ok, millis)), digits).alias("mean_ok"))


def distinct_phrases(rows: DataFrame, phrase: str, order: str, key: Column) -> DataFrame:
    """``(phrase, n)``: one row per key, in its first spelling."""
    return rows.where(F.col(phrase).isNotNull() & (key != "")).groupBy(key.alias("__key")).agg(F.min_by(phrase, order).alias("phrase"), F.count("*").alias("n")).drop("__key")


def cap_groups(groups: DataFrame, most: int) -> DataFrame:
    """``groups(name, size)`` with kept: the ``most`` largest, ties by name."""
    top = groups.orderBy(F.desc("size"), "name").limit(most).select("name", F.lit(True).alias("kept"))
    return groups.join(F.broadcast(top), "name", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def claim_first(answers: DataFrame, size: int) -> DataFrame:
    """``(name, members)`` from ``answers(ord, name, members array<int>)``.

    Members outside 0..size-1 and repeats drop out, the first group to name one keeps it, and
    empty groups vanish.
    """
    named = answers.select("ord", "name", F.posexplode("members").alias("pos", "member")).where(F.col("member").between(0, size - 1))
    first = named.groupBy("member").agg(F.min_by(F.struct("ord", "name", "pos"), F.struct("ord", "pos")).alias("f"))
    return first.groupBy("f.ord", "f.name").agg(F.array_sort(F.collect_list("member")).alias("members")).select("ord", "name", "members")


def merge_groups(groups: DataFrame, key: Column) -> DataFrame:
    """``(name, why, size)``: groups with one key become one, with its first name and first reason."""
    first_why = F.min_by(F.nullif(F.col("why"), F.lit("")), F.when(F.col("why") != "", F.col("ord")))
    return groups.groupBy(key.alias("__key")).agg(F.min_by("name", "ord").alias("name"), first_why.alias("why"), F.sum("size").alias("size")).drop("__key")


def hit_rate(rows: DataFrame, by: str, hit: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count("*"), 4).alias("rate"))


def find_text(rows: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """Rows whose text contains the needle, as it is."""
    return rows.where(F.col(text).contains(needle)).select(key)


def trigram_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(gram, key, tf)``: every three-character piece of the lower-case text, counted within its row.

    Rows stand for themselves, so a key that comes twice has its pieces twice.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, whole in enumerate(batch.column(1).to_pylist()):
                grams = Counter(map("".join, zip(whole, whole[1:], whole[2:], strict=False)))
                own = pa.array([n], pa.int32()).take(pa.array(np.zeros(len(grams), np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), batch.column(0).take(own), pa.array(list(grams.values()), pa.int64())], ["gram", key, "tf"])

    low = rows.where(F.length(text) >= 3).select(key, F.lower(F.col(text)).alias("low"))
    return low.mapInArrow(counted, f"gram string, {key} {rows.schema[key].dataType.simpleString()}, tf long")


def search(rows: DataFrame, key: str, text: str, words: list[str], top: int = 20) -> DataFrame:
    """``(key, score)``: rows that hold every word, best first.

    A word scores how often it stands in the text, by tf / (tf + 1) times the log of how rare it
    is among all rows. Words are compared without case.
    """
    low = F.lower(F.col(text))
    counts = [(F.length(low) - F.length(F.replace(low, F.lit(w.lower())))) / len(w) for w in words]
    n = rows.agg(F.count("*").alias("n"), *(F.count_if(low.contains(w.lower())).alias(f"d{i}") for i, w in enumerate(words))).first()
    score = F.lit(0.0)
    for i, count in enumerate(counts):
        score = score + count / (count + 1) * F.log(F.lit((n["n"] + 1) / (n[f"d{i}"] + 1)) + 1)
    hits = rows
    for w in words:
        hits = hits.where(low.contains(w.lower()))
    return hits.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(top)


def rank_within(rows: DataFrame, by: str, order: list, top: int) -> DataFrame:
    """``rows`` with rank, the first ``top`` of every group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= top)
