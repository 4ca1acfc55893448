"""From raw documents to packed training sequences, one operator of filewright.llm a stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.llm import packing, pii, quality, simhash
from filewright.llm._shared import stash
from filewright.session import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, fitted on the labelled ones among them.

    A null text is scored like an empty one. Repeated rows are scored and kept each; without labels, or
    with an empty table, nothing is learned and every score is one half, which is accepted. Columns of any
    name are returned as they are.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    SimHash over five-word shingles, links verified at a similarity of 0.8 or more. Null and blank texts
    are one group; of rows with one doc_id, or none, the first stays. An empty table gives no rows.
    """
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text.

    A null text stays null and has no characters. Repeated rows are redacted each; an empty table gives
    no rows.
    """
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens.

    A null text is packed as an empty one: its end id alone. Repeated rows are packed each; ties are
    broken by row; an empty table gives no rows; other columns are not returned.
    """
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    packed = packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_distinct),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: No SQL expresses the fitted classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
