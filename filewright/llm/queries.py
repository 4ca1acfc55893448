"""The registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.llm import alignment, bpe, differencing, embed_dedup, hard_negatives, html_extract, packing, pii, quality, simhash, topk, url_filter, warc
from filewright.session import table


def op1_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    light = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(light).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"n_{kind}" for kind in pii.KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: Dated entries of the lists that op10 evaluates: policy, entry, action, day.
URL_EVENTS = (
    ("block", "cheap-pills.example.com", "add", "2024-02-01"),
    ("block", "cheap-pills.example.com", "remove", "2024-06-01"),
    ("block", "cheap-pills.example.com", "add", "2024-09-15"),
    ("block", "spam-farm.example.org", "add", "2024-03-10"),
    ("block", "example.net", "add", "2024-07-01"),
    ("block", "example.net", "remove", "2024-08-01"),
    ("allow", "tionsh.example.net", "add", "2024-07-10"),
    ("allow", "tionsh.example.net/fr", "add", "2024-01-01"),
    ("block", "blog.tionble.example.com/en", "add", "2024-04-01"),
    ("block", "blog.tionble.example.com/en", "remove", "2024-11-01"),
    ("block", "m.tiontion.example.com/de", "add", "2024-05-05"),
    ("block", "www.ththen.example.com", "add", "2024-05-01"),
    ("block", "www.ththen.example.com", "remove", "2024-05-01"),
)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time, so it is derived from the id: an hour of the year 2024."""
    hours = (F.col("page_id") * 37 % (366 * 24)).cast("int")
    fetched = F.timestamp_add("HOUR", hours, F.lit("2024-01-01").cast("timestamp_ntz"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    events = spark.createDataFrame(list(URL_EVENTS), "policy string, entry string, action string, day string")
    events = events.select("policy", "entry", "action", F.col("day").cast("timestamp_ntz").alias("at"))
    return url_filter.evaluate(captures, events)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.report(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differencing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


_URL_VALUES = ", ".join(f"('{p}', '{e}', '{a}', TIMESTAMP '{d} 00:00:00')" for p, e, a, d in URL_EVENTS)
OP10_SQL = f"""
WITH events(policy, entry, action, moment) AS (VALUES {_URL_VALUES}),
spans AS (SELECT policy, entry, action, moment AS since, lead(moment) OVER (PARTITION BY policy, entry ORDER BY moment, action) AS until FROM events),
active AS (SELECT * FROM spans WHERE action = 'add' AND (until IS NULL OR until > since)),
captures AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(page_id * 37 % (366 * 24) AS INTEGER) AS fetched_at,
    lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]+)', 1)) AS host,
    regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/+$', '') AS path
  FROM pages),
hits AS (
  SELECT c.page_id, a.policy, a.entry, a.since,
    row_number() OVER (PARTITION BY c.page_id ORDER BY length(a.entry) DESC, (a.policy = 'allow') DESC) AS pick,
    count(*) OVER (PARTITION BY c.page_id) AS n
  FROM captures c JOIN active a ON a.since <= c.fetched_at AND (a.until IS NULL OR c.fetched_at < a.until)
    AND (c.host = a.entry OR ends_with(c.host, '.' || a.entry) OR c.host || c.path = a.entry OR starts_with(c.host || c.path, a.entry || '/')))
SELECT c.page_id, c.url, c.fetched_at, coalesce(h.policy = 'block', false) AS blocked, h.policy, h.entry, h.since, coalesce(h.n, 0) AS n_active
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.pick = 1
"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
r AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_embed_dedup, op2_packing, op3_html, op4_bpe, op5_warc, op6_pii, op7_simhash, op8_quality, op9_topk, op10_url_filter,
        op11_hard_negatives, op12_alignment, op13_differencing,
    )
}
ORACLES: dict[str, str] = {"op9_topk": OP9_SQL, "op10_url_filter": OP10_SQL, "op11_hard_negatives": OP11_SQL}
