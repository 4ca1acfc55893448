"""Registered queries of the file and document operators, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.functions import secrets, text, values
from filewright.operators import copies, lookups, rules, sequences, state, summaries
from filewright.session import table
from filewright.sources import catalogue

NOW = "2024-06-01 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def files(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.from_documents(table(spark, sf, "documents"), NOW)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


_NAMES = ", ".join(f"'{n}'" for n in catalogue.NAMES)
FILES = f"""files AS (
  SELECT *, lower(regexp_extract(name, '[^.](\\.[^./]+)$', 1)) AS ext, mtime + INTERVAL 1 HOUR * CAST(id % 48 AS INTEGER) AS first_seen_at,
    '/home/u/Downloads/' || source || '/' || CASE WHEN id % 3 = 0 THEN 'old/x/' ELSE '' END || name AS path,
    CASE WHEN bytes > 0 THEN sha256(text) END AS sha
  FROM (SELECT doc_id AS id, replace(([{_NAMES}])[doc_id % {len(catalogue.NAMES)} + 1], '{{}}', CAST(doc_id AS VARCHAR)) AS name,
    TIMESTAMP '{NOW}' - INTERVAL 1 HOUR * CAST(doc_id * 7919 % 3000 AS INTEGER) AS mtime,
    CASE WHEN doc_id % 17 = 0 THEN 0 ELSE strlen(text) END AS bytes, text, source FROM documents))"""
# The SQL spells out its own values, so that a wrong constant of an operator shows.
_REFUSED = """(name LIKE '.%'
  OR lower(name) IN ('.ssh', '.gnupg', '.aws', '.kube', '.config', '.git', 'ssh', 'gnupg', 'keychain', 'keychains', 'credentials', 'credential', 'secrets', 'secret', 'tokens', 'token')
  OR regexp_matches(lower(name), '^(\\.env|\\.npmrc|\\.netrc|id_rsa|id_ed25519|id_ecdsa|id_dsa|data\\.db)(\\..*)?$')
  OR regexp_matches(lower(name), '\\.(db|sqlite|sqlite3|pem|key|p12|pfx|ini|cfg|conf|lnk|url)$'))"""
DRAFTS = f"""aged AS (SELECT *, CAST(floor(epoch(TIMESTAMP '{NOW}' - mtime) / 86400) AS BIGINT) AS age FROM files WHERE NOT {_REFUSED}),
drafts AS (
  SELECT id AS item_id, 'partial' AS kind, 95 AS confidence, 'unfinished download' AS reason, age FROM aged WHERE ext IN ('.crdownload', '.part', '.partial', '.download', '.opdownload', '.filepart') AND age >= 1
  UNION ALL SELECT id, 'empty', 95, 'empty file', age FROM aged WHERE bytes = 0 AND age >= 1
  UNION ALL SELECT id, 'temp', 85, 'temporary file', age FROM aged WHERE bytes > 0 AND ext IN ('.tmp', '.temp') AND age >= 7
  UNION ALL SELECT id, 'installer', 70, 'old installer', age FROM aged WHERE ext IN ('.dmg', '.pkg', '.msi', '.exe') AND age >= 14
  UNION ALL SELECT id, 'archive', 65, 'old archive', age FROM aged WHERE ext IN ('.zip', '.rar', '.7z', '.tar', '.gz', '.tgz') AND age >= 30
  UNION ALL SELECT id, 'old-download', 35, 'not touched for long', age FROM aged WHERE ext NOT IN ('.pages', '.numbers') AND age >= 14
  UNION ALL SELECT id, 'screenshot-noise', 35, 'old screenshot', age FROM aged WHERE regexp_matches(lower(name), '^(screenshot|screen shot)') AND age >= 30)"""
LISTING = f"""top AS (SELECT item_id, arg_min(kind, (100 - confidence, kind)) AS kind, max(confidence) AS confidence, count(*) AS n_kinds FROM drafts GROUP BY item_id),
listing AS (SELECT item_id, kind, confidence, n_kinds, confidence >= 50 AS checked FROM top)"""


# --- catalogue, rules and copies ---


@query("SELECT doc_id, keeper, n_copies FROM (SELECT doc_id, first_value(doc_id) OVER w AS keeper, count(*) OVER (PARTITION BY sha256(text)) AS n_copies FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id)) WHERE doc_id <> keeper")
def exact_duplicates(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return copies.copies(docs, "sha256", "doc_id", F.col("doc_id"))


_COPY = "CASE WHEN regexp_matches(name, ' \\([0-9]{1,3}\\)\\.[a-z]+$| - copy\\.[a-z]+$') THEN 1 ELSE 0 END"


@query(f"WITH {FILES}, ranked AS (SELECT id, first_value(id) OVER w AS keeper, count(*) OVER (PARTITION BY sha) AS n_copies FROM files WHERE sha IS NOT NULL WINDOW w AS (PARTITION BY sha ORDER BY first_seen_at, {_COPY}, path, id)) SELECT * FROM ranked WHERE id <> keeper")
def copies_by_first_seen(spark, sf):
    return copies.exact(files(spark, sf))


@query(f"WITH {FILES}, ranked AS (SELECT id, first_value(id) OVER w AS keeper, first_value(sha) OVER w AS keeper_sha, sha, count(*) OVER (PARTITION BY text) AS n_copies FROM files WHERE length(text) >= 200 WINDOW w AS (PARTITION BY text ORDER BY first_seen_at, {_COPY}, path, id)) SELECT id, keeper, n_copies FROM ranked WHERE id <> keeper AND sha IS DISTINCT FROM keeper_sha")
def same_text_copies(spark, sf):
    return copies.same_text(files(spark, sf))


@query("SELECT sha256(text) AS content, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("content")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {FILES}, picked AS (SELECT * FROM files WHERE id % 3 = 1), outside AS (SELECT DISTINCT sha FROM files WHERE id % 3 <> 1) SELECT p.id, o.sha IS NOT NULL AS safe FROM picked p LEFT JOIN outside o ON p.sha = o.sha")
def keeper_survives(spark, sf):
    """Selected files are a third of the catalogue, which is the operator's input here."""
    items = files(spark, sf).select("id", "sha256")
    return copies.keeper_survives(items.where("id % 3 = 1").select("id"), items)


@query(f"WITH {FILES}, {DRAFTS} SELECT * FROM drafts")
def rule_candidates(spark, sf):
    return rules.candidates(files(spark, sf), now())


@query(f"WITH {FILES}, {DRAFTS}, {LISTING} SELECT * FROM listing")
def candidate_listing(spark, sf):
    return rules.top_candidate(rules.candidates(files(spark, sf), now()))


@query(f"WITH {FILES}, {DRAFTS}, {LISTING}, sized AS (SELECT l.*, f.bytes FROM listing l JOIN files f ON f.id = l.item_id), shown AS (SELECT * FROM sized ORDER BY confidence DESC, kind, item_id LIMIT 50) SELECT (SELECT count(*) FROM sized) AS n_items, (SELECT count(*) FROM sized WHERE checked) AS n_checked, (SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM sized WHERE checked) AS checked_bytes, (SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM shown) AS shown_bytes, (SELECT count(*) > 50 FROM sized) AS truncated")
def candidate_totals(spark, sf):
    items = files(spark, sf)
    listing = rules.top_candidate(rules.candidates(items, now())).join(items.select(F.col("id").alias("item_id"), "bytes"), "item_id")
    return rules.totals(listing, 50)


@query(f"WITH {FILES}, {DRAFTS}, {LISTING} SELECT kind, count(*) AS n, count(*) FILTER (WHERE checked) AS hits, round(count(*) FILTER (WHERE checked) / count(*), 4) AS rate FROM listing GROUP BY kind")
def checked_rate_by_kind(spark, sf):
    listing = rules.top_candidate(rules.candidates(files(spark, sf), now()))
    return summaries.hit_rate(listing, "kind", F.col("checked"))


@query(f"WITH {FILES}, {DRAFTS}, before AS (SELECT item_id, kind FROM drafts), later AS (SELECT DISTINCT item_id, kind FROM drafts WHERE age >= 40) SELECT b.item_id, b.kind FROM before b WHERE NOT EXISTS (SELECT 1 FROM later l WHERE l.item_id = b.item_id AND l.kind = b.kind)")
def stale_candidates(spark, sf):
    found = rules.candidates(files(spark, sf), now())
    return state.stale(found.select("item_id", "kind"), found.where("age >= 40"), ["item_id", "kind"])


@query(f"WITH {FILES}, {DRAFTS}, {LISTING} SELECT id, CASE WHEN l.item_id IS NOT NULL AND checked THEN 'cleanup' WHEN l.item_id IS NOT NULL THEN 'review' ELSE 'catalogue' END AS listed_in FROM files LEFT JOIN listing l ON l.item_id = id")
def first_listing(spark, sf):
    items = files(spark, sf)
    listing = rules.top_candidate(rules.candidates(items, now())).withColumnRenamed("item_id", "id")
    return lookups.listing_reason([("cleanup", listing.where("checked")), ("review", listing), ("catalogue", items)], "id")


@query(f"WITH {FILES}, o AS (SELECT id, name, bytes, 'candidate' AS status FROM files WHERE id % 4 <> 0), n AS (SELECT id, 'x-' || name AS name, bytes + 1 AS bytes, 'new' AS status FROM files WHERE id % 3 = 0) SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, CAST(coalesce(o.bytes, n.bytes) AS BIGINT) AS bytes, CASE WHEN o.status = 'candidate' THEN o.status ELSE coalesce(n.status, o.status) END AS status FROM o FULL JOIN n ON o.id = n.id")
def catalogue_upsert(spark, sf):
    items = files(spark, sf)
    old = items.where("id % 4 <> 0").select("id", "name", "bytes", F.lit("candidate").alias("status"))
    new = items.where("id % 3 = 0").select("id", F.concat(F.lit("x-"), "name").alias("name"), (F.col("bytes") + 1).alias("bytes"), F.lit("new").alias("status"))
    return state.upsert(old, new, "id", ["bytes"], {"status": ["candidate"]})


@query(f"WITH {FILES} SELECT id FROM files WHERE id % 5 = 0")
def missing_files(spark, sf):
    items = files(spark, sf).select("id")
    return state.missing(items, items.where("id % 5 <> 0"), "id")


@query(f"WITH {FILES}, roots(root) AS (VALUES ('/home/u/Downloads'), ('/home/u/Downloads/src1'), ('/home/u/Downloads/src2/old'), ('/home/u/Documents')) SELECT id, (SELECT arg_max(root, length(root)) FROM roots WHERE starts_with(path, root || '/')) AS root FROM files")
def deepest_root(spark, sf):
    roots = spark.createDataFrame([("/home/u/Downloads",), ("/home/u/Downloads/src1/",), ("/home/u/Downloads/src2/old",), ("/home/u/Documents",)], "root string")
    return lookups.deepest_root(files(spark, sf).select("id", "path"), roots).select("id", "root")


# --- events ---


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def latest_event(spark, sf):
    return state.latest(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


@query("SELECT count(*) AS n_calls, count(*) FILTER (WHERE event_type <> 'error') AS n_ok, count(*) FILTER (WHERE event_type = 'error') AS n_failed, round(avg(value) FILTER (WHERE event_type <> 'error'), 3) AS mean_ok FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def call_stats(spark, sf):
    return summaries.call_stats(table(spark, sf, "events").where("ts >= timestamp_ntz'2024-01-10'"), F.col("event_type") != "error", F.col("value"))


SEGMENTS = "seg AS (SELECT user_id, ts, event_id, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS segment FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS opens FROM events))"


@query(f"WITH {SEGMENTS} SELECT user_id, segment, count(*) AS n FROM seg GROUP BY ALL")
def gap_segments(spark, sf):
    rows = sequences.gap_segments(table(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 3600)
    return rows.groupBy("user_id", "segment").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n, CAST(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS span_seconds FROM events GROUP BY user_id")
def user_spans(spark, sf):
    return sequences.spans(table(spark, sf, "events"), "user_id", "ts")


@query("SELECT event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 40) AS BIGINT) AS chunk FROM events")
def batches(spark, sf):
    return sequences.chunks(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 40).select("event_id", "chunk")


@query("WITH e AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events), r AS (SELECT user_id, g, count(*) AS n FROM e WHERE bad GROUP BY ALL) SELECT user_id, max(n) AS longest FROM r GROUP BY user_id HAVING max(n) >= 3")
def failure_streaks(spark, sf):
    return sequences.streaks(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").where("longest >= 3")


@query("SELECT p.event_id FROM events p WHERE p.event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id AND e.event_type = 'error' AND e.ts > p.ts)")
def still_active(spark, sf):
    events = table(spark, sf, "events")
    return lookups.without_later(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), events.where("event_type = 'error'"), "user_id", "ts").select("event_id")


@query("SELECT a.event_id AS a, b.event_id AS b, (epoch_us(b.ts) - epoch_us(a.ts)) / 1000000 AS seconds_apart FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE AND (a.ts < b.ts OR a.event_id < b.event_id)")
def interval_pairs(spark, sf):
    return lookups.within(table(spark, sf, "events"), ["user_id", "event_type"], "event_id", "ts", 1800)


@query("SELECT user_id, max(ts) FILTER (WHERE event_type = 'error') AS failed_at FROM events GROUP BY user_id HAVING max(ts) FILTER (WHERE event_type = 'error') IS NOT NULL AND (max(ts) FILTER (WHERE event_type = 'purchase') IS NULL OR max(ts) FILTER (WHERE event_type = 'purchase') < max(ts) FILTER (WHERE event_type = 'error'))")
def active_errors(spark, sf):
    events = table(spark, sf, "events")
    return lookups.active_errors(events.where("event_type = 'error'"), events.where("event_type = 'purchase'"), ["user_id"], "ts")


_OP = "CASE event_type WHEN 'view' THEN 'quarantine' WHEN 'click' THEN 'restore' WHEN 'purchase' THEN 'purge' WHEN 'error' THEN 'quarantine' ELSE 'skip' END"
_STATUS = "CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 7 = 0 THEN 'started' ELSE 'done' END"
OUTCOMES = f"""j AS (SELECT event_id AS seq, user_id % 10 AS plan_id, event_id % 2000 AS item_id, {_OP} AS op, {_STATUS} AS status FROM events),
l AS (SELECT plan_id, item_id, arg_max(status, seq) FILTER (WHERE op = 'quarantine') AS q, arg_max(status, seq) FILTER (WHERE op = 'restore') AS r, arg_max(status, seq) FILTER (WHERE op = 'purge') AS p, arg_max(status, seq) FILTER (WHERE op = 'skip') AS s FROM j GROUP BY ALL),
o AS (SELECT plan_id, item_id, CASE WHEN p = 'done' THEN 'purged' WHEN r = 'done' THEN 'restored' WHEN r = 'started' THEN 'restoring' WHEN q = 'done' THEN 'moved' WHEN q = 'failed' THEN 'failed' WHEN q = 'started' THEN 'unfinished' WHEN s IS NOT NULL THEN 'skipped' ELSE 'proposed' END AS outcome FROM l)"""


def _journal(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 10).alias("plan_id"), (F.col("event_id") % 2000).alias("item_id"), F.expr(_OP).alias("op"), F.expr(_STATUS).alias("status"))


@query(f"WITH {OUTCOMES} SELECT * FROM o")
def plan_outcomes(spark, sf):
    return state.outcomes(_journal(spark, sf))


@query(f"WITH {OUTCOMES} SELECT plan_id, CASE WHEN count(*) FILTER (WHERE outcome IN ('unfinished', 'restoring')) > 0 THEN 'unresolved' WHEN count(*) FILTER (WHERE outcome = 'failed') > 0 AND count(*) FILTER (WHERE outcome IN ('moved', 'purged')) = 0 THEN 'error' WHEN count(*) FILTER (WHERE outcome = 'failed') > 0 THEN 'partial' WHEN count(*) FILTER (WHERE outcome IN ('moved', 'purged')) = 0 AND count(*) FILTER (WHERE outcome = 'restored') > 0 THEN 'restored' WHEN count(*) FILTER (WHERE outcome IN ('moved', 'purged')) > 0 THEN 'applied' ELSE 'proposed' END AS status, count(*) AS n FROM o GROUP BY plan_id")
def plan_status(spark, sf):
    return state.settle_plans(state.outcomes(_journal(spark, sf)))


@query("SELECT event_type, user_id, count(*) AS times, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY ALL")
def preference_counters(spark, sf):
    return state.counters(table(spark, sf, "events"), ["event_type", "user_id"], "value", ["ts", "event_id"])


PREFS = "prefs AS (SELECT CASE WHEN event_type = 'error' THEN 'rejected' ELSE event_type END AS kind, user_id AS id, count(*) AS times, max(ts) AS at_ FROM events GROUP BY ALL)"


@query(f"WITH {PREFS} SELECT kind, id, times FROM prefs ORDER BY (kind = 'rejected'), times DESC, at_ DESC, id DESC, kind LIMIT 200")
def preferences_kept(spark, sf):
    """The 200 best are the operator's result: a store of bounded size."""
    kind = F.when(F.col("event_type") == "error", "rejected").otherwise(F.col("event_type"))
    prefs = table(spark, sf, "events").groupBy(kind.alias("kind"), F.col("user_id").alias("id")).agg(F.count("*").alias("times"), F.max("ts").alias("at"))
    return state.evict(prefs, 200).select("kind", "id", "times")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 500")
def newest_events(spark, sf):
    return state.newest(table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id", 500).select("event_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 50")
def strict_json(spark, sf):
    parsed = F.from_json("props", "k int")
    alone = F.array_size(F.json_object_keys("props")) == 1
    return table(spark, sf, "events").where(alone & (parsed["k"] >= 50)).select("event_id", parsed["k"].alias("k"))


# --- orders and lines ---


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate)")
def pending_items(spark, sf):
    answers = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("at"))
    return lookups.pending(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [answers], "o_orderkey", "o_orderdate", "at").select("o_orderkey")


@query("WITH t AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS tier, l_partkey * 10 + l_linenumber AS key, l_shipdate AS day FROM lineitem), f AS (SELECT t.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY tier, day DESC, key) AS pick FROM t JOIN orders ON o_orderkey = l_orderkey WHERE day >= o_orderdate) SELECT l_orderkey AS o_orderkey, tier, key, day AS at FROM f WHERE pick = 1".replace(" AS at ", ' AS "at" '))
def first_fresh_answer(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("l_shipdate").alias("at"), "l_returnflag")
    tiers = [lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"), lines.where("l_returnflag not in ('A', 'R')")]
    return lookups.first_answer(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), tiers, "o_orderkey", "o_orderdate")


@query("SELECT o_custkey, o_orderkey, o_totalprice, supersedes FROM (SELECT *, lead(o_orderkey) OVER w AS supersedes, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)) WHERE n = 1")
def current_facts(spark, sf):
    return state.current_facts(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice", "supersedes")


@query("SELECT CAST(floor(greatest(0, epoch(TIMESTAMP '2001-08-02' - o_orderdate)) / 86400) AS BIGINT) AS age, count(*) AS n FROM orders GROUP BY 1")
def age_histogram(spark, sf):
    age = values.age_days(F.col("o_orderdate"), F.lit("2001-08-02").cast("timestamp_ntz"))
    return table(spark, sf, "orders").groupBy(age.alias("age")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderdate + INTERVAL 1000 DAY <= TIMESTAMP '2000-01-01' THEN 'stale' WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'candidate' END AS status FROM orders")
def expiry_sweep(spark, sf):
    facts = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("candidate").alias("status"), F.timestamp_add("DAY", F.lit(1000), "o_orderdate").alias("expires_at"))
    return state.swept(facts, F.lit("2000-01-01").cast("timestamp_ntz")).select("o_orderkey", "status")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 80")
def third_page(spark, sf):
    return state.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 80, 40).select("o_orderkey")


@query("WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY n DESC, o_custkey) AS running, row_number() OVER (ORDER BY n DESC, o_custkey) AS nth FROM g) SELECT o_custkey, n, CAST(running AS BIGINT) AS running FROM r WHERE running <= 1000 AND nth <= 50")
def default_selection(spark, sf):
    groups = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return state.greedy_prefix(groups, "n", [F.desc("n"), "o_custkey"], 1000, 50)


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3")
def top_per_customer(spark, sf):
    return summaries.rank_within(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 3).drop("o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def double_anti_join(spark, sf):
    orders, key = table(spark, sf, "orders"), F.col("o_custkey").alias("c_custkey")
    return lookups.without(table(spark, sf, "customer").select("c_custkey"), orders.where("o_totalprice > 400000").select(key), orders.where("o_orderstatus = 'P'").select(key), by="c_custkey")


# --- phrases, labels and text ---


@query("SELECT arg_min(p_name, p_partkey) AS phrase, count(*) AS n FROM part GROUP BY lower(trim(p_name))")
def distinct_phrases(spark, sf):
    return summaries.distinct_phrases(table(spark, sf, "part"), "p_name", "p_partkey", text.phrase_key(F.col("p_name")))


@query("WITH g AS (SELECT p_brand AS name, count(*) AS size FROM part GROUP BY 1) SELECT name, size, row_number() OVER (ORDER BY size DESC, name) <= 12 AS kept FROM g")
def capped_groups(spark, sf):
    return summaries.cap_groups(table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("size")), 12)


@query("WITH g AS (SELECT p_partkey AS ord, p_type AS name, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS why, p_size AS size FROM part) SELECT arg_min(name, ord) AS name, arg_min(why, ord) FILTER (WHERE why <> '') AS why, CAST(sum(size) AS BIGINT) AS size FROM g GROUP BY lower(name)")
def merged_groups(spark, sf):
    groups = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.col("p_type").alias("name"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")).alias("why"), F.col("p_size").alias("size"))
    return summaries.merge_groups(groups, text.course_key(F.col("name")))


ALIASES = (("colour", "red", 0), ("colour", "blue", 1), ("ring", "ring", 2), ("fastener", "bolt", 3), ("red ring", "red ring", 4), ("size", "small", 5))


@query(f"WITH r(name, alias, ord) AS (VALUES {', '.join(map(str, ALIASES))}), m AS (SELECT p_partkey, r.name, p_name = alias AS exact, row_number() OVER (PARTITION BY p_partkey ORDER BY p_name <> alias, length(alias) DESC, ord) AS pick FROM part JOIN r ON contains(p_name, alias)) SELECT p_partkey, name, exact FROM m WHERE pick = 1")
def alias_match(spark, sf):
    registry = spark.createDataFrame(list(ALIASES), "name string, alias string, ord int")
    return lookups.alias_match(table(spark, sf, "part"), registry, "p_partkey", "p_name")


@query("SELECT doc_id FROM documents WHERE contains(text, 'License')")
def text_contains(spark, sf):
    return summaries.find_text(table(spark, sf, "documents"), "doc_id", "text", "License")


@query("WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE contains(t, 'license')) AS a, count(*) FILTER (WHERE contains(t, 'apache')) AS b FROM d), s AS (SELECT doc_id, (length(t) - length(replace(t, 'license', ''))) / 7 AS x, (length(t) - length(replace(t, 'apache', ''))) / 6 AS y FROM d WHERE contains(t, 'license') AND contains(t, 'apache')) SELECT doc_id, round(x / (x + 1) * ln((n + 1) / (a + 1) + 1) + y / (y + 1) * ln((n + 1) / (b + 1) + 1), 6) AS score FROM s, n ORDER BY score DESC, doc_id LIMIT 20")
def text_search(spark, sf):
    return summaries.search(table(spark, sf, "documents"), "doc_id", "text", ["License", "Apache"])


@query("SELECT gram, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT gram, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substring(lower(text), i, 3))) AS gram FROM documents WHERE length(text) >= 3) GROUP BY ALL) GROUP BY gram")
def trigram_counts(spark, sf):
    index = summaries.trigram_index(table(spark, sf, "documents"), "doc_id", "text")
    return index.groupBy("gram").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n"))


#: The contents alone, in the order of the patterns; names "doc N.txt" never say a secret. Where the
#: engine's patterns look behind or ahead, these take one character more. Card numbers are the longest groups of digits from any group on.
_SECRETS = r"""WITH d AS (SELECT doc_id, text, lower(text) AS low FROM documents),
runs AS (SELECT doc_id, regexp_split_to_array(unnest(regexp_extract_all(text, '[0-9](?:[ -]?[0-9])+')), '[ -]') AS groups FROM d),
starts AS (SELECT doc_id, groups, unnest(range(1, len(groups) + 1)) AS i FROM runs),
spans AS (SELECT doc_id, list_filter(list_transform(range(i, len(groups) + 1), lambda j: array_to_string(groups[i:j], '')), lambda x: length(x) BETWEEN 13 AND 19)[-1] AS digits FROM starts),
cards AS (SELECT DISTINCT doc_id FROM spans WHERE digits IS NOT NULL
  AND list_sum(list_transform(range(length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(digits[length(digits) - i] AS INTEGER)
    ELSE CAST(digits[length(digits) - i] AS INTEGER) * 2 - CASE WHEN CAST(digits[length(digits) - i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0),
tables AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(regexp_split_to_array(substring(text, 1, 4000), '\r?\n')[1:40]) AS line FROM d)
  WHERE length(line) <= 400 AND regexp_matches(line, '(?i)\b(?:username|user_name|user|account|login|email)\b|帳號|使用者|電子郵件|信箱')
    AND regexp_matches(line, '(?i)\b(?:password|passwd|pwd|secret|passphrase)\b|密碼|通行碼|口令') AND regexp_matches(line, '[,;\t|:]')),
found AS (SELECT d.doc_id, CASE
  WHEN regexp_matches(text, '-----BEGIN[A-Z0-9 ]{0,40}PRIVATE KEY-----') THEN 'a private key header'
  WHEN contains(text, '-----BEGIN PGP PRIVATE KEY BLOCK-----') THEN 'a PGP private key header'
  WHEN contains(text, '-----BEGIN CERTIFICATE-----') THEN 'a certificate header'
  WHEN regexp_matches(text, '(^|[^A-Z0-9])(AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}($|[^0-9A-Z])') THEN 'an AWS key id'
  WHEN regexp_matches(low, 'aws_secret_access_key\s*[:=]') THEN 'an AWS secret key field'
  WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{16,}|(^|[^A-Za-z0-9_])github_pat_[A-Za-z0-9_]{20,}') THEN 'GitHub token'
  WHEN regexp_matches(text, '(^|[^A-Za-z0-9_-])sk-[A-Za-z0-9_-]{16,}') THEN 'a key starting with sk-'
  WHEN regexp_matches(text, '(^|[^A-Za-z0-9_-])xox[abprs]-[A-Za-z0-9-]{8,}') THEN 'Slack token'
  WHEN regexp_matches(text, '(^|[^A-Za-z0-9_-])AIza[0-9A-Za-z_-]{35}($|[^0-9A-Za-z_-])') THEN 'a Google API key'
  WHEN regexp_matches(text, '(?i)authorization\s*[:=]\s*["'']?bearer\s+[A-Za-z0-9._~+/=-]{16,}') THEN 'a Bearer authorization header'
  WHEN regexp_matches(text, '(^|[^A-Za-z0-9])[A-Za-z][12][0-9]{8}($|[^0-9A-Za-z])') THEN 'a national ID number'
  WHEN regexp_matches(text, '(^|[^A-Za-z0-9_-])(sk|rk)_(live|test)_[A-Za-z0-9]{10,}') THEN 'a Stripe key'
  WHEN regexp_matches(text, '(?i)(postgres(ql)?|mysql|mongodb(\+srv)?|redis|amqp|ftp|ssh)://[^\s:@/]+:[^\s@/]{3,}@') THEN 'a connection string with a password'
  WHEN regexp_matches(text, '(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}') THEN 'JWT'
  WHEN regexp_matches(text, 'kind:\s*Secret\b') THEN 'Kubernetes Secret'
  WHEN regexp_matches(text, '(?m)^[^\s:]+:\d{1,5}:[^\s:]*:[^\s:]+:\S+$') THEN 'a .pgpass line'
  WHEN regexp_matches(text, '(?i)(^|[\s,{"''])(private_key|privatekey|client_secret|api[_-]?secret)["'']?\s*[:=]') THEN 'a private key field'
  WHEN d.doc_id IN (SELECT doc_id FROM cards) THEN 'a credit card number'
  WHEN d.doc_id IN (SELECT doc_id FROM tables) THEN 'table' END AS told FROM d)
SELECT doc_id, CASE WHEN told = 'table' THEN 'the contents look like a table of usernames and passwords' ELSE 'the contents hold ' || told END AS reason FROM found WHERE told IS NOT NULL"""


@query(_SECRETS)
def secret_screen(spark, sf):
    reason = secrets.screen(F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", reason.alias("reason")).where("reason is not null")


@query(f"WITH {FILES} SELECT id, regexp_matches(name, ' \\([0-9]{{1,3}}\\)\\.[a-z]+$| - copy\\.[a-z]+$') AS looks_like_copy, regexp_replace(name, ' \\([0-9]{{1,3}}\\)(\\.[a-z]+)$| - copy(\\.[a-z]+)$', '\\1\\2') AS bare FROM files")
def copy_names(spark, sf):
    name = F.col("name")
    return files(spark, sf).select("id", text.looks_like_copy(name).alias("looks_like_copy"), text.strip_copy_suffix(name).alias("bare"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_spellings(spark, sf):
    """The same day written in four ways must read back as one."""
    d = F.col("o_orderdate")
    year, month, day = F.year(d), F.month(d), F.dayofmonth(d)
    written = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy/M/d")).when(F.col("o_orderkey") % 4 == 1, F.format_string("民國 %d 年 %d 月 %d 日", year - 1911, month, day)).when(F.col("o_orderkey") % 4 == 2, F.format_string("%d年%02d月%d日", year, month, day)).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", values.to_date(written).alias("day"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '+8869' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN c_custkey % 3 = 1 THEN '+8862' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone FROM customer")
def phone_numbers(spark, sf):
    n = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("09"), F.substring(n, 1, 2), F.lit("-"), F.substring(n, 3, 3), F.lit("-"), F.substring(n, 6, 3))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("+886 (2) "), n)).otherwise(F.concat(F.lit("09"), F.substring(n, 1, 5)))
    return table(spark, sf, "customer").select("c_custkey", values.to_e164(raw).alias("phone"))


@query("""WITH RECURSIVE signs AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS s FROM embeddings),
cut AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 1000 AS chunk FROM signs),
placed AS (SELECT *, row_number() OVER (PARTITION BY label, chunk ORDER BY vec_id DESC) AS n FROM cut),
step AS (
  SELECT label, chunk, n, vec_id, vec_id AS leader, [{'k': vec_id, 's': s}] AS leads FROM placed WHERE n = 1
  UNION ALL
  SELECT label, chunk, n, vec_id, coalesce(hit, vec_id), CASE WHEN hit IS NULL THEN list_append(leads, {'k': vec_id, 's': s}) ELSE leads END
  FROM (SELECT p.*, t.leads, list_filter(t.leads, lambda l: list_sum(list_transform(list_zip(l.s, p.s), lambda z: CAST(z[1] <> z[2] AS INTEGER))) <= 20)[1].k AS hit
    FROM step t JOIN placed p ON p.label = t.label AND p.chunk = t.chunk AND p.n = t.n + 1))
SELECT vec_id, leader FROM step""")
def signature_leaders(spark, sf):
    """Leader clusters of sign signatures within a label, in bounded chunks."""
    signs = F.aggregate("embedding", F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    rows = table(spark, sf, "embeddings").select("vec_id", "label", signs.alias("signature"), F.timestamp_seconds(F.col("vec_id")).alias("at"))
    cut = sequences.chunks(rows, ["label"], ["vec_id"], 1000)
    return sequences.leaders(cut, ["label", "chunk"], "vec_id", "at", "signature", 20)
