"""Registered queries of the operators on histories: facts, learned preferences, plans, renames, intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from filewright.functions import secrets, untitled
from filewright.operators import admission, facts, filing, groups, health, identity, learned, lookups, validation
from filewright.queries import ORACLES, QUERIES, query
from filewright.session import shared_path, table, written
from filewright.streaming import intake, sink

__all__ = ["ORACLES", "QUERIES"]

# Each user's events are read as the commands of an owner; the SQL steps through them one by one.

_FACTS = """WITH RECURSIVE c AS (
  SELECT user_id, row_number() OVER w AS n, event_id AS seq,
    CASE event_type WHEN 'view' THEN 'propose' WHEN 'click' THEN 'confirm' WHEN 'purchase' THEN 'manual' WHEN 'signup' THEN 'reject' ELSE 'undo' END AS op,
    CASE WHEN event_type IN ('view', 'purchase') THEN event_id ELSE last_value(CASE WHEN event_type IN ('view', 'purchase') THEN event_id END IGNORE NULLS) OVER w END AS fact,
    'k' || (event_id % 3) AS key, 1 + event_id % 3 AS pops
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(op VARCHAR, fact BIGINT, key VARCHAR, prev BIGINT, seq BIGINT)[]) AS stack FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT c.user_id, c.n, CASE
    WHEN c.op = 'propose' THEN list_append(stack, {'op': 'propose', 'fact': c.fact, 'key': c.key, 'prev': NULL, 'seq': c.seq})
    WHEN c.op = 'manual' THEN list_append(list_append(stack, {'op': 'propose', 'fact': c.fact, 'key': c.key, 'prev': NULL, 'seq': c.seq}),
      {'op': 'confirm', 'fact': c.fact, 'key': c.key, 'prev': CASE WHEN list_filter(stack, lambda x: x.fact = list_filter(stack, lambda y: y.key = c.key AND y.op = 'confirm')[-1].fact)[-1].op = 'confirm' THEN list_filter(stack, lambda y: y.key = c.key AND y.op = 'confirm')[-1].fact END, 'seq': c.seq})
    WHEN c.op = 'confirm' AND own[-1].op = 'propose' THEN list_append(stack, {'op': 'confirm', 'fact': c.fact, 'key': own[1].key,
      'prev': CASE WHEN list_filter(stack, lambda x: x.fact = list_filter(stack, lambda y: y.key = own[1].key AND y.op = 'confirm')[-1].fact)[-1].op = 'confirm' THEN list_filter(stack, lambda y: y.key = own[1].key AND y.op = 'confirm')[-1].fact END, 'seq': c.seq})
    WHEN c.op = 'reject' AND len(own) > 0 THEN list_append(stack, {'op': 'reject', 'fact': c.fact, 'key': own[1].key, 'prev': NULL, 'seq': c.seq})
    WHEN c.op = 'undo' THEN stack[1:greatest(0, len(stack) - c.pops)]
    ELSE stack END
  FROM (SELECT s.user_id, s.n, s.stack, list_filter(s.stack, lambda x: x.fact = d.fact) AS own FROM s JOIN c d ON d.user_id = s.user_id AND d.n = s.n + 1) s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1),
ends AS (SELECT user_id, unnest(stack) AS e, generate_subscripts(stack, 1) AS at_ FROM s QUALIFY n = max(n) OVER (PARTITION BY user_id)),
said AS (SELECT user_id, e.fact AS fact, at_, CASE e.op WHEN 'propose' THEN 'candidate' WHEN 'confirm' THEN 'confirmed' ELSE 'rejected' END AS status, e.seq AS seq FROM ends
  UNION ALL SELECT user_id, e.prev, at_, 'superseded', NULL FROM ends WHERE e.prev IS NOT NULL)
SELECT f.user_id AS owner, f.fact AS fact_id, any_value(k.e.key) AS key, 'v' || f.fact AS value, arg_max(f.status, f.at_) AS status,
  (SELECT arg_max(e.prev, at_) FROM ends x WHERE x.user_id = f.user_id AND x.e.fact = f.fact AND x.e.op = 'confirm') AS supersedes, arg_max(f.seq, f.at_) FILTER (WHERE f.seq IS NOT NULL) AS seq
FROM said f JOIN ends k ON k.user_id = f.user_id AND k.e.fact = f.fact AND k.e.op = 'propose' GROUP BY f.user_id, f.fact"""


@query(_FACTS)
def fact_history(spark, sf):
    from pyspark.sql import Window

    made = F.when(F.col("event_type").isin("view", "purchase"), F.col("event_id"))
    before = F.last(made, ignorenulls=True).over(Window.partitionBy("user_id").orderBy("event_id"))
    ops = {"view": "propose", "click": "confirm", "purchase": "manual", "signup": "reject", "error": "undo"}
    op = F.element_at(F.create_map(*(F.lit(x) for pair in ops.items() for x in pair)), F.col("event_type"))
    n = F.col("event_id")
    commands = table(spark, sf, "events").select(F.col("user_id").alias("owner"), n.alias("seq"), op.alias("op"), before.alias("fact_id"), F.concat(F.lit("k"), (n % 3).cast("string")).alias("key"), F.concat(F.lit("v"), n.cast("string")).alias("value"), (1 + n % 3).alias("n"))
    return facts.history(commands)


_LEARNED = """WITH RECURSIVE c AS (
  SELECT user_id % 20 AS owner, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS n, event_id AS seq,
    CASE event_type WHEN 'error' THEN 'reject' WHEN 'signup' THEN CASE WHEN event_id % 97 = 0 THEN 'clear' ELSE 'forget' END ELSE 'learn' END AS op,
    CASE event_type WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'file_kind' ELSE 'course' END AS kind,
    CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 25 AS VARCHAR) AS k, CASE WHEN event_type = 'error' THEN '' ELSE 'v' || event_id END AS v
  FROM events),
s AS (
  SELECT owner, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(kind VARCHAR, k VARCHAR, v VARCHAR, times BIGINT, a BIGINT, born BIGINT)[]) AS store, CAST(0 AS BIGINT) AS evicted FROM (SELECT DISTINCT owner FROM c)
  UNION ALL
  SELECT owner, n, CASE WHEN len(made) > 12 THEN list_filter(made, lambda x: x.born <> low.born) ELSE made END, CASE WHEN op = 'clear' THEN 0 WHEN len(made) > 12 THEN evicted + 1 ELSE evicted END
  FROM (SELECT *, list_min(list_transform(list_filter(made, lambda x: x.born <> seq), lambda x: {'keep': x.kind <> 'rejected', 'times': x.times, 'a': x.a, 'born': x.born})) AS low
    FROM (SELECT c.*, s.evicted, CASE
      WHEN c.op = 'clear' THEN s.store[1:0]
      WHEN c.op = 'forget' THEN list_filter(s.store, lambda x: NOT (x.kind = c.kind AND x.k = c.k))
      WHEN len(list_filter(s.store, lambda x: x.kind = c.kind AND x.k = c.k)) > 0
        THEN list_transform(s.store, lambda x: CASE WHEN x.kind = c.kind AND x.k = c.k THEN {'kind': x.kind, 'k': x.k, 'v': c.v, 'times': x.times + 1, 'a': c.seq, 'born': x.born} ELSE x END)
      ELSE list_append(s.store, {'kind': c.kind, 'k': c.k, 'v': c.v, 'times': 1, 'a': c.seq, 'born': c.seq}) END AS made
      FROM s JOIN c ON c.owner = s.owner AND c.n = s.n + 1)))
"""
_STORE = _LEARNED + ", e AS (SELECT owner, unnest(store) AS x, evicted FROM s QUALIFY n = max(n) OVER (PARTITION BY owner))"


def _preferences(spark, sf):
    kind = F.when(F.col("event_type") == "click", "file_kind").otherwise("course")
    op = F.when(F.col("event_type") == "error", "reject").when(F.col("event_type") != "signup", "learn").when(F.col("event_id") % 97 == 0, "clear").otherwise("forget")
    k = (F.from_json("props", "k int")["k"] % 25).cast("string")
    commands = table(spark, sf, "events").select((F.col("user_id") % 20).alias("owner"), F.col("event_id").alias("seq"), op.alias("op"), kind.alias("kind"), k.alias("k"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("v"))
    return learned.learned(commands, 12)


@query(_STORE + ' SELECT owner, x.kind AS kind, x.k AS k, x.v AS v, x.times AS times, x.a AS "at", x.born AS born, evicted, CAST(row_number() OVER (PARTITION BY owner ORDER BY x.times DESC, x.a DESC) AS INTEGER) AS rank FROM e')
def learned_preferences(spark, sf):
    """Stores of twelve preferences an owner: the bound is the operator's."""
    return learned.ranked(_preferences(spark, sf))


@query(_STORE + ", q AS (SELECT event_id, user_id % 20 AS owner, CAST(value * 100 AS BIGINT) % 25 AS key FROM events) SELECT q.event_id, (SELECT any_value(x.v) FROM e WHERE e.owner = q.owner AND x.kind = 'course' AND x.k = CAST(q.key AS VARCHAR)) AS learned_course, (SELECT any_value(x.v) FROM e WHERE e.owner = q.owner AND x.kind = 'file_kind' AND x.k = CAST(q.key AS VARCHAR)) AS learned_file_kind, EXISTS (SELECT 1 FROM e WHERE e.owner = q.owner AND x.kind = 'rejected' AND x.k = CAST(q.key AS VARCHAR)) AS was_rejected FROM q")
def learned_suggestions(spark, sf):
    key = ((F.col("value") * 100).cast("decimal(18,0)") % 25).cast("long").cast("string")
    asked = table(spark, sf, "events").select("event_id", (F.col("user_id") % 20).alias("owner"), key.alias("key"))
    return learned.applied(asked, _preferences(spark, sf), {"course": F.col("key"), "file_kind": F.col("key")}, F.col("key")).drop("owner", "key")


# A month's orders ask for its parts; some are sent again, some share the id of a request, and a
# line with the number 7 is not listed. Parts of different months are different items.
_ADMISSION = """WITH RECURSIVE o AS (SELECT o_orderkey AS seq, o_orderkey AS key, strftime(o_orderdate, '%Y-%m') AS month FROM orders
  UNION ALL SELECT o_orderkey + 100000000, o_orderkey, strftime(o_orderdate, '%Y-%m') FROM orders WHERE o_orderkey % 9 = 0),
r AS (SELECT seq, month, month || '-' || CAST(key // 40 AS VARCHAR) AS rid, coalesce(list_sort(list_distinct(list(l_orderkey * 10 + l_linenumber) FILTER (WHERE l_orderkey IS NOT NULL))), []) AS ids,
    coalesce(list_sort(list_distinct(list(month || '-' || l_partkey) FILTER (WHERE l_linenumber < 7))), []) AS items, count(*) FILTER (WHERE l_linenumber >= 7) AS unlisted
  FROM o LEFT JOIN lineitem ON l_orderkey = key AND key % 11 <> 0 GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY seq) AS n FROM r),
s AS (SELECT month, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(item VARCHAR, seq BIGINT)[]) AS held, CAST([] AS STRUCT(rid VARCHAR, ids BIGINT[], seq BIGINT)[]) AS known,
    CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS rid, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS plan, CAST(NULL AS BIGINT) AS n_items FROM (SELECT DISTINCT month FROM c)
  UNION ALL
  SELECT month, n, CASE WHEN status = 'accepted' THEN list_concat(held, list_transform(items, lambda x: {'item': x, 'seq': seq})) ELSE held END,
    CASE WHEN status = 'accepted' THEN list_append(known, {'rid': rid, 'ids': ids, 'seq': seq}) ELSE known END, seq, rid, status,
    CASE WHEN status = 'accepted' THEN seq WHEN prior IS NOT NULL THEN prior.seq WHEN status = 'conflict' THEN holder END, len(items)
  FROM (SELECT *, CASE WHEN prior.ids = ids THEN 'repeated' WHEN prior IS NOT NULL THEN 'request conflict' WHEN unlisted > 0 THEN 'stale' WHEN len(items) = 0 THEN 'empty' WHEN holder IS NOT NULL THEN 'conflict' ELSE 'accepted' END AS status
    FROM (SELECT c.*, s.held, s.known, list_filter(s.known, lambda x: x.rid = c.rid)[1] AS prior, list_min(list_transform(list_filter(s.held, lambda x: list_contains(c.items, x.item)), lambda x: x.seq)) AS holder
      FROM s JOIN c ON c.month = s.month AND c.n = s.n + 1)))
SELECT seq, rid AS request_id, status, plan, n_items FROM s WHERE seq IS NOT NULL"""


@query(_ADMISSION)
def plan_admission(spark, sf):
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey").alias("line"))
    # the lines of one order
    dated = written(orders.select(key.alias("key"), month).join(lines.groupBy("key").agg(F.collect_list("line").alias("lines")), "key", "left"), "plans-orders")
    sent = dated.withColumn("seq", F.col("key")).unionByName(dated.where("key % 9 = 0").withColumn("seq", F.col("key") + 100_000_000))
    ids = F.when(F.col("key") % 11 != 0, F.transform("lines", lambda x: F.col("key") * 10 + x["l_linenumber"]))
    requests = sent.select("seq", F.concat_ws("-", "month", F.floor(F.col("key") / 40).cast("string")).alias("request_id"), ids.alias("ids"))
    line = dated.select("key", "month", F.explode("lines").alias("line")).where("line.l_linenumber < 7")
    listing = line.select((F.col("key") * 10 + F.col("line.l_linenumber")).alias("id"), F.concat_ws("-", "month", F.col("line.l_partkey").cast("string")).alias("item"))
    return admission.admitted(requests, listing)


# Users rename files among a hundred paths of their own; every third path is catalogued at first.
_FOLLOWED = """WITH RECURSIVE c AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id AS seq, 1 + CAST(json_extract(props, '$.k') AS INTEGER) % 100 AS source, 1 + (event_id * 7 + user_id) % 100 AS target FROM events),
s AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, list_transform(range(1, 101), lambda i: CASE WHEN i % 3 = 0 THEN user_id * 1000 + i END) AS at_path FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT c.user_id, c.n, CASE WHEN c.source = c.target THEN at_path ELSE list_transform(range(1, 101), lambda i: CASE
    WHEN i = c.source THEN NULL WHEN i = c.target THEN coalesce(at_path[c.target], at_path[c.source], -c.seq - 1) ELSE at_path[i] END) END
  FROM s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1),
ends AS (SELECT user_id, at_path FROM s QUALIFY n = max(n) OVER (PARTITION BY user_id)),
live AS (SELECT user_id, unnest(range(1, 101)) AS i, unnest(at_path) AS occupant FROM ends)
SELECT user_id || '/' || i AS path, CASE WHEN occupant >= 0 THEN occupant END AS item, CASE WHEN occupant < 0 THEN -occupant - 1 END AS born, 'live' AS status FROM live WHERE occupant IS NOT NULL
UNION ALL SELECT user_id || '/' || i, user_id * 1000 + i, NULL, 'missing' FROM live l WHERE i % 3 = 0 AND NOT EXISTS (SELECT 1 FROM live o WHERE o.user_id = l.user_id AND o.occupant = l.user_id * 1000 + l.i)"""


@query(_FOLLOWED)
def followed_files(spark, sf):
    events = table(spark, sf, "events")
    user = F.col("user_id").cast("string")

    def path(n):
        return F.concat_ws("/", user, n.cast("string"))

    source, target = 1 + F.from_json("props", "k int")["k"] % 100, 1 + (F.col("event_id") * 7 + F.col("user_id")) % 100
    renames = events.select(F.col("event_id").alias("seq"), path(source).alias("source"), path(target).alias("target"))
    n = F.explode(F.sequence(F.lit(3), F.lit(99), F.lit(3))).alias("n")
    catalogue = events.select("user_id").distinct().select("user_id", n).select((F.col("user_id") * 1000 + F.col("n")).cast("long").alias("item"), path(F.col("n")).alias("path"))
    return identity.followed(catalogue, renames, 1000)


# Users' events are observations of ten files each, an hour apart at most in a batch; every other
# path was there before. A last observation, long after the others, lets all timers end.
_LIMITS = intake.Limits(settle=2 * 3600 * 1000, retry=6 * 3600 * 1000, remember=5 * 24 * 3600 * 1000)
_OBSERVED = """o AS (SELECT user_id || '/' || event_id % 10 AS path, event_id % 4 AS size, epoch_ms(TIMESTAMP '2023-12-20') + (event_id % 5) * 86400000 + (epoch_us(ts) // 1000) // 864000000 * 864000000 - epoch_ms(TIMESTAMP '2023-12-20') // 864000000 * 864000000 AS mtime,
    event_type = 'signup' AND event_id % 3 = 0 AS gone, CASE WHEN event_type = 'error' THEN 'later' WHEN event_id % 7 = 0 THEN 'never' ELSE 'ok' END AS verdict, (epoch_us(ts) // 1000) AS at_ms FROM events)"""
_INTAKE = f"""WITH RECURSIVE {_OBSERVED},
c AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY at_ms, size, mtime) AS n, coalesce(lead(at_ms) OVER (PARTITION BY path ORDER BY at_ms, size, mtime), 4000000000000) AS next_ms FROM o),
s AS (
  SELECT path, CAST(0 AS BIGINT) AS n, CASE WHEN had THEN 1 END AS seen_size, CASE WHEN had THEN epoch_ms(TIMESTAMP '2023-12-31') END AS seen_mtime, CASE WHEN had THEN epoch_ms(TIMESTAMP '2024-01-01') + 432000000 END AS seen_until,
    CAST(NULL AS BIGINT) AS size, CAST(NULL AS BIGINT) AS mtime, CAST(NULL AS BIGINT) AS due, CAST(NULL AS VARCHAR) AS verdict, CAST(0 AS BIGINT) AS tries,
    CAST(NULL AS BIGINT) AS h_size, CAST(NULL AS BIGINT) AS h_mtime, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS h_tries, CAST(NULL AS BIGINT) AS h_at
  FROM (SELECT DISTINCT path, CAST(right(path, 1) AS INTEGER) % 2 = 0 AS had FROM o)
  UNION ALL
  SELECT path, n, CASE WHEN ended THEN NULL WHEN done AND keeps THEN size ELSE seen_size END, CASE WHEN ended THEN NULL WHEN done AND keeps THEN mtime ELSE seen_mtime END, CASE WHEN ended THEN NULL ELSE until END,
    CASE WHEN NOT done THEN size END, CASE WHEN NOT done THEN mtime END, CASE WHEN NOT done THEN due + 21600000 * more END, CASE WHEN NOT done THEN verdict END, CASE WHEN done THEN 0 ELSE tries + more END,
    CASE WHEN done THEN size END, CASE WHEN done THEN mtime END, CASE WHEN done THEN CASE verdict WHEN 'ok' THEN 'accepted' WHEN 'later' THEN 'given up' ELSE 'refused' END END, CASE WHEN done THEN tries + need END, CASE WHEN done THEN last_due END
  FROM (SELECT *, coalesce(until <= next_ms, false) AS ended
    FROM (SELECT *, CASE WHEN done AND keeps THEN last_due + 432000000 ELSE seen_until END AS until
      FROM (SELECT *, coalesce(seen_until <= last_due + 432000000, true) AS keeps
        FROM (SELECT *, coalesce(more >= need, false) AS done, due + 21600000 * (need - 1) AS last_due
          FROM (SELECT *, CASE WHEN due <= next_ms THEN least((next_ms - due) // 21600000 + 1, need) ELSE 0 END AS more
            FROM (SELECT *, CASE WHEN verdict = 'later' THEN greatest(5 - tries, 1) ELSE 1 END AS need
              FROM (SELECT path, n, next_ms, seen_size, seen_mtime, seen_until, CASE WHEN gone THEN NULL WHEN waits OR begins THEN o_size END AS size, CASE WHEN gone THEN NULL WHEN waits OR begins THEN o_mtime END AS mtime,
                  CASE WHEN gone THEN NULL WHEN waits AND size = o_size AND mtime = o_mtime THEN due WHEN waits OR begins THEN at_ms + 7200000 END AS due,
                  CASE WHEN gone THEN NULL WHEN waits OR begins THEN o_verdict END AS verdict, CASE WHEN gone OR NOT waits THEN 0 ELSE tries END AS tries
                FROM (SELECT c.path, c.n, c.next_ms, c.at_ms, c.gone, c.verdict AS o_verdict, c.size AS o_size, c.mtime AS o_mtime, s.seen_size, s.seen_mtime, s.seen_until, s.size, s.mtime, s.due, s.tries, s.due IS NOT NULL AS waits,
                    s.due IS NULL AND NOT c.gone AND NOT coalesce(s.seen_size = c.size AND s.seen_mtime = c.mtime, false) AND NOT (s.seen_until IS NULL AND c.mtime <= c.at_ms - 432000000) AS begins
                  FROM (SELECT c.at_ms AS now_ms, t.* REPLACE (CASE WHEN seen_until > c.at_ms THEN seen_size END AS seen_size, CASE WHEN seen_until > c.at_ms THEN seen_mtime END AS seen_mtime, CASE WHEN seen_until > c.at_ms THEN seen_until END AS seen_until)
                    FROM s t JOIN c ON c.path = t.path AND c.n = t.n + 1) s JOIN c ON c.path = s.path AND c.n = s.n + 1)))))))))
SELECT path, h_size AS size, h_mtime AS mtime, outcome, CAST(h_tries AS INTEGER) AS tries, h_at AS at_ms FROM s WHERE outcome IS NOT NULL"""


def _observed(events):
    """The observations; times are whole milliseconds."""
    n, ms = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    base = F.unix_millis(F.lit("2023-12-20").cast("timestamp"))
    mtime = base + n % 5 * 86_400_000 + F.floor(ms / 864_000_000) * 864_000_000 - F.floor(base / 864_000_000) * 864_000_000
    verdict = F.when(F.col("event_type") == "error", intake.FOR_NOW).when(n % 7 == 0, intake.REFUSED).otherwise(intake.ACCEPTED)
    path = F.concat_ws("/", F.col("user_id").cast("string"), (n % 10).cast("string"))
    return events.select(path.alias("path"), (n % 4).alias("size"), mtime.alias("mtime"), ((F.col("event_type") == "signup") & (n % 3 == 0)).alias("gone"), verdict.alias("verdict"), F.timestamp_millis(ms).alias("at"))


@query(_INTAKE)
def intake_replay(spark, sf):
    """The events as a stream of files, each a trigger, then one observation that ends all timers."""
    events = table(spark, sf, "events")
    rows = _observed(events)
    there = rows.select("path").distinct().where("cast(right(path, 1) as int) % 2 = 0")
    there = there.select("path", F.lit(1).cast("long").alias("size"), F.unix_millis(F.lit("2023-12-31").cast("timestamp")).alias("mtime"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    end = spark.range(1).select(F.lit("~end").alias("path"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.lit(True).alias("gone"), F.lit("ok").alias("verdict"), F.timestamp_millis(F.lit(4_100_000_000_000)).alias("at"))
    folder = shared_path(spark, "intake-end")
    end.write.parquet(folder)
    closing = spark.readStream.schema(end.schema).parquet(folder)
    groups = max(1, events.count() // 500)  # a path has some seven events
    return intake.replayed(spark, _observed(stream).unionByName(closing), there, _LIMITS, groups=groups)[0]


_JOURNAL = "j AS (SELECT event_id AS seq, user_id % 10 AS plan_id, event_id % 2000 AS item_id, CASE WHEN event_type IN ('view', 'error') THEN 'quarantine' WHEN event_type = 'click' THEN 'restore' ELSE 'skip' END AS op, CASE WHEN event_id % 3 = 0 THEN 'started' ELSE 'done' END AS status, CASE WHEN event_id % 13 > 0 THEN 'm' || event_id % 4 END AS mark FROM events)"
_FILES = "f AS (SELECT item_id, place, CASE WHEN (item_id + side) % 6 > 1 THEN 'm' || (item_id * (side + 1)) % 4 END AS mark FROM (SELECT DISTINCT event_id % 2000 AS item_id FROM events), (VALUES (0, 'origin'), (1, 'quarantine')) p(side, place) WHERE (item_id + side) % 5 > 0)"


@query(f"WITH {_JOURNAL}, {_FILES}, b AS (SELECT j.*, CASE WHEN op = 'restore' THEN o.mark ELSE q.mark END AS target, CASE WHEN op = 'restore' THEN q.mark ELSE o.mark END AS source FROM j LEFT JOIN f o ON o.item_id = j.item_id AND o.place = 'origin' LEFT JOIN f q ON q.item_id = j.item_id AND q.place = 'quarantine' WHERE status = 'started' AND op <> 'skip') SELECT seq, plan_id, item_id, op, CASE WHEN target = mark THEN 'done' WHEN source = mark AND target IS NULL THEN CASE WHEN op = 'restore' THEN 'failed' ELSE 'reverted' END ELSE 'started' END AS status FROM b")
def crash_recovery(spark, sf):
    n, kind = F.col("event_id"), F.col("event_type")
    op = F.when(kind.isin("view", "error"), "quarantine").when(kind == "click", "restore").otherwise("skip")
    journal = table(spark, sf, "events").select(n.alias("seq"), (F.col("user_id") % 10).alias("plan_id"), (n % 2000).alias("item_id"), op.alias("op"), F.when(n % 3 == 0, "started").otherwise("done").alias("status"), F.when(n % 13 > 0, F.concat(F.lit("m"), (n % 4).cast("string"))).alias("mark"))
    item, side = F.col("item_id"), F.col("side")
    found = journal.select("item_id").distinct().select("item_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).where((item + side) % 5 > 0)
    mark = F.when((item + side) % 6 > 1, F.concat(F.lit("m"), (item * (side + 1) % 4).cast("string")))
    return sink.recovered(journal, found.select("item_id", F.when(side == 0, "origin").otherwise("quarantine").alias("place"), mark.alias("mark")))


#: Names that hold a number, and what each is by the rules, worked out by hand.
_NAMED = (
    ("IMG_#.jpg", "untitled", "camera"), ("IMG_#_night.jpg", "named", "named"), ("PXL_#_141203123.PORTRAIT-01.COVER.jpg", "untitled", "camera"), ("DSC#.ARW", "untitled", "camera"),
    ("Untitled.pages", "generic", "extension is a word"), ("Untitled-%.ai", "generic", "extension is a word"), ("Untitled.Algebra", "named", "named"), ("未命名 %.docx", "untitled", "untitled word"),
    ("Untitled.pdf.crdownload", "untitled", "untitled word"), ("無題.txt", "generic", "general words"), ("無題 %.odt", "untitled", "untitled word"), ("新增 Microsoft Word 文件 (%).docx", "untitled", "windows new"),
    ("Document%.docx", "untitled", "office"), ("Document (%).pdf", "untitled", "office"), ("Document %.pdf", "named", "named"), ("Book%.xlsx", "untitled", "office"), ("book.epub", "generic", "general words"),
    ("Screenshot_#-141203_Chrome.jpg", "untitled", "screenshot"), ("Screenshot_#-141203_midterm.jpg", "named", "named"), ("Screenshot_#-141203_com.android.chrome.png", "untitled", "screenshot"),
    ("Screenshot_#-141203_com.new.final.png", "named", "named"), ("Screenshot 2026-09-19 at 2.12.03 PM (%).png", "untitled", "screenshot"), ("Screenshot at.png", "named", "named"), ("Screenshot from # 141203.png", "untitled", "screenshot"),
    ("截圖 % 上午 # .png", "untitled", "screenshot"), ("Scan %.jpeg", "untitled", "scan"), ("Adobe Scan Sep %, 2026.pdf", "untitled", "scan"), ("Scan May %.pdf", "named", "named"), ("photo_#_14-12-03.jpg", "untitled", "messenger"),
    ("photo_%.jpg", "named", "named"), ("IMG-#-WA0003.jpg", "untitled", "messenger"), ("S__#.jpg", "untitled", "line"), ("LINE_ALBUM_畢業旅行_%.jpg", "named", "named"), ("New Recording %.m4a", "untitled", "recording"),
    ("download (%).pdf", "untitled", "browser"), ("image.png - Copy (%)", "named", "named"), ("# (%).pdf", "untitled", "digits"), ("0123456789abcdef#.zip", "untitled", "hash"), ("0123456789abcdef#.bin", "named", "named"), ("deadbeef-#-4a4a-8b8b.txt", "named", "named"),
    ("報告最終版v%.docx", "named", "named"), ("報告最終版 v%.docx", "generic", "general words"), ("講義第二版 (%).pdf", "generic", "general words"), ("final_report-v2.%.docx", "generic", "general words"), ("lecture %.pdf", "named", "named"),
    ("Copy of Copy of notes (%).txt", "generic", "general words"), ("😀😀 (%).png", "generic", "emoji"), ("____ (%).txt", "untitled", "digits"), ("____.txt", "untitled", "symbols"), (".pdf", "untitled", "empty"), (".bashrc%", "named", "named"), ("~$報告%.docx", "named", "temporary"),
    ("/home/u/x\\ＩＭＧ＿#.jpg", "untitled", "camera"), ("期中考範圍 %.docx", "named", "named"), ("- 複製.txt", "generic", "general words"), ("myreportfinal%.doc", "named", "named"), ("myreportfinal (%).doc", "generic", "general words"),
)
_NAMED_SQL = ", ".join(f"({n}, '{name}', '{state}', '{reason}')" for n, (name, state, reason) in enumerate(_NAMED))


@query(f"WITH t(n, name, state, reason) AS (VALUES {_NAMED_SQL}) SELECT doc_id, replace(replace(name, '#', lpad(CAST(doc_id AS VARCHAR), 8, '0')), '%', CAST(doc_id % 90 + 1 AS VARCHAR)) AS name, state, reason FROM documents JOIN t ON n = doc_id % {len(_NAMED)}")
def name_classes(spark, sf):
    """Documents named after the kinds of names that users and programs give."""
    doc = F.col("doc_id")
    kind = F.element_at(F.lit([name for name, *_ in _NAMED]), (doc % len(_NAMED) + 1).cast("int"))
    name = F.replace(F.replace(kind, F.lit("#"), F.lpad(doc.cast("string"), 8, "0")), F.lit("%"), (doc % 90 + 1).cast("string"))
    named = table(spark, sf, "documents").select("doc_id", name.alias("name"))
    return named.select("doc_id", "name", untitled.name_class(F.col("name")).alias("c")).select("doc_id", "name", "c.state", "c.reason")


# --- validation, groups and health ---

_REGISTRY = (
    ("profile.birthday", "date", None, False, "normal"), ("profile.since", "month", None, False, "normal"), ("contact.phone", "tel", None, False, "personal"),
    ("contact.email", "email", None, False, "personal"), ("skills[].level", "enum", ["B1", "Level 2", "可遠端"], True, "normal"), ("score", "number", None, False, "normal"),
    ("consent", "boolean", None, False, "normal"), ("pin", "string", None, False, "secret"), ("site", "url", None, False, "normal"), ("note", "text", None, False, "normal"),
    ("extra[]", "string", None, False, "normal"),
)
#: Keys and written values with a number in each, and what they are by the rules: the normal value or the problems.
_WRITTEN = (
    ("profile.birthday", " ２０２４/1/# ", "2024-01-~", ""), ("profile.birthday", "# soon", "", "not of type date"), ("profile.since", "2024-01-~", "2024-01", ""), ("contact.phone", "09#2-345-678", "+8869#2345678", ""),
    ("contact.email", "Ａ#＠Example．com", "a#@example.com", ""), ("contact.email", "a# @x", "", "not of type email"), ("skills[#].level", "Ｌｅｖｅｌ　2", "Level 2", ""), ("skills.level", "B1", "", "unknown key"),
    ("skills[].level", "B1", "", "needs an index"), ("score", "１#.50", "1#.5", ""), ("score", "#e400", "", "not of type number"), ("score[#]", "#", "", "unknown key"), ("extra[#]", "#", "", "takes no index"), ("consent", "no #", "true", ""), ("pin", "#", "", "secret"),
    ("pin", "", "", "secret,empty"), ("site", "HTTPS://Example.com?q=#", "https://example.com/?q=#", ""), ("site", "example #", "", "not of type url"), ("note", " two\nlines ＃# ", "two\nlines ＃#", ""), ("what#", "", "", "unknown key"), ("note", None, "", "empty"),
)


def _spelled(x):
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_VETTED = f"""WITH t(n, key, value, normal, problems) AS (VALUES {', '.join(f'({n}, {", ".join(map(_spelled, row))})' for n, row in enumerate(_WRITTEN))}),
e AS (SELECT event_id, CAST(event_id % 9 + 1 AS VARCHAR) AS d, event_id % {len(_WRITTEN)} AS kind FROM events)
SELECT event_id, replace(key, '#', d) AS key, replace(replace(value, '#', d), '~', lpad(d, 2, '0')) AS value, CASE WHEN problems = '' THEN replace(replace(normal, '#', d), '~', lpad(d, 2, '0')) END AS normal, problems FROM e JOIN t ON n = kind"""


@query(_VETTED)
def vetted_values(spark, sf):
    registry = spark.createDataFrame(list(_REGISTRY), "key string, type string, allowed array<string>, repeatable boolean, sensitivity string")
    kinds = F.lit([list(map(lambda x: x or "", row[:2])) for row in _WRITTEN])
    digit, kind = (F.col("event_id") % 9 + 1).cast("string"), (F.col("event_id") % len(_WRITTEN) + 1).cast("int")
    row = F.element_at(kinds, kind)
    value = F.when(kind != len(_WRITTEN), F.replace(F.replace(F.element_at(row, 2), F.lit("~"), F.lpad(digit, 2, "0")), F.lit("#"), digit))
    told = table(spark, sf, "events").select("event_id", F.replace(F.element_at(row, 1), F.lit("#"), digit).alias("key"), value.alias("value"))
    return validation.vetted(told, registry).select("event_id", "key", "value", "normal", F.array_join("problems", ",").alias("problems"))


_OLD = "o AS (SELECT event_id AS item, 'g' || user_id % 50 AS group_id, user_id % 50 AS keeper, CASE WHEN event_id % 3 = 0 THEN 'same' ELSE 'similar' END AS level FROM events WHERE event_id % 4 > 0 OR event_id < 50)"
_NEW = "n AS (SELECT event_id AS item, 'g' || (user_id + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) % 50 AS group_id, (user_id + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) % 50 AS keeper, CASE WHEN event_id % 3 = 0 THEN 'same' ELSE 'similar' END AS level FROM events WHERE event_id % 5 > 0 OR event_id < 50)"


def _versions(spark, sf):
    n, level = F.col("event_id"), F.when(F.col("event_id") % 3 == 0, "same").otherwise("similar")
    moved = (F.col("user_id") + F.when(n % 11 == 0, 1).otherwise(0)) % 50
    events = table(spark, sf, "events")

    def version(group, rest):
        return events.where((n % rest > 0) | (n < 50)).select(n.alias("item"), F.concat(F.lit("g"), group.cast("string")).alias("group_id"), group.cast("long").alias("keeper"), level.alias("level"))

    return version(F.col("user_id") % 50, 4), version(moved, 5), events


@query(f"WITH {_OLD}, {_NEW} SELECT coalesce(n.item, o.item) AS item, CASE WHEN n.item IS NULL THEN 'removed' WHEN e.event_id % 13 = 0 THEN 'stale' WHEN o.item IS NULL THEN 'added' ELSE 'changed' END AS change, coalesce(n.group_id, o.group_id) AS group_id, coalesce(n.keeper, o.keeper) AS keeper, coalesce(n.level, o.level) AS level FROM o FULL JOIN n ON o.item = n.item JOIN events e ON e.event_id = coalesce(n.item, o.item) WHERE e.event_id % 7 > 0 AND (o.item IS NULL OR n.item IS NULL OR o.group_id <> n.group_id)")
def group_changes(spark, sf):
    old, new, events = _versions(spark, sf)
    scope = events.where("event_id % 7 > 0").select(F.col("event_id").alias("item"), (F.col("event_id") % 13 > 0).alias("fresh"))
    return groups.changes(old, new, scope)


@query(f"""WITH {_NEW}, r AS (SELECT n.*, 'f' || item AS name, item % 977 AS bytes, ts AS mtime, item = keeper AS is_keeper FROM n JOIN events ON event_id = item WHERE event_type <> 'error'),
w AS (SELECT group_id, any_value(CASE WHEN is_keeper THEN mtime END) AS at_, any_value(CASE WHEN is_keeper THEN level END) AS level, count(*) FILTER (WHERE NOT is_keeper) AS n, CAST(round((epoch_us(max(mtime)) - epoch_us(min(mtime))) / 1000000) AS BIGINT) AS span_seconds FROM r GROUP BY group_id HAVING bool_or(is_keeper) AND count(*) > 1),
p AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY mtime DESC, item) AS nth FROM r WHERE NOT is_keeper)
SELECT p.group_id, CAST((nth - 1) // 100 AS INTEGER) AS page, any_value(keeper) AS keeper, any_value(at_) AS "at", any_value(w.level) AS level, any_value(n) AS n, any_value(span_seconds) AS span_seconds, string_agg(item || ':' || name || ':' || bytes || ':' || p.level, ',' ORDER BY nth) AS members FROM p JOIN w ON w.group_id = p.group_id GROUP BY p.group_id, (nth - 1) // 100""")
def group_view(spark, sf):
    _, new, events = _versions(spark, sf)
    n = F.col("event_id")
    items = events.select(n.alias("item"), F.concat(F.lit("f"), n.cast("string")).alias("name"), (n % 977).alias("bytes"), F.col("ts").alias("mtime"), "event_type")
    view = groups.nested(new, items, F.col("event_type") != "error", 100)
    return view.withColumn("members", F.array_join(F.transform("members", lambda m: F.concat_ws(":", *(m[c].cast("string") for c in ("item", "name", "bytes", "level")))), ","))


@query(f"""WITH {_JOURNAL}, d AS (SELECT event_id AS seq, CASE WHEN event_id % 401 > 0 THEN ts END AS completed_at, event_id % 977 AS bytes, ts - INTERVAL 1 HOUR * CAST(event_id % 100 AS INTEGER) AS mtime FROM events),
q AS (SELECT d.*, EXISTS (SELECT 1 FROM j r WHERE r.plan_id = j.plan_id AND r.item_id = j.item_id AND r.op = 'restore' AND r.status = 'started') AS restoring FROM j JOIN d ON d.seq = j.seq
  WHERE op = 'quarantine' AND status = 'done' AND j.seq % 17 > 0 AND NOT EXISTS (SELECT 1 FROM j r WHERE r.plan_id = j.plan_id AND r.item_id = j.item_id AND r.op = 'restore' AND r.status = 'done')),
o AS (SELECT count(*) AS items, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, min(mtime) AS oldest_mtime, min(completed_at) FILTER (WHERE NOT restoring) + INTERVAL 7 DAY AS can_empty_at, greatest(0, (SELECT count(*) FROM events) // 3 - count(*)) AS orphans, count(*) FILTER (WHERE NOT restoring AND completed_at IS NULL) > 0 AS truncated FROM q)
SELECT *, items > 0 AND NOT truncated AND can_empty_at <= TIMESTAMP '2024-06-01' AS can_empty_now, CASE WHEN truncated THEN 'worried' WHEN items > 0 THEN 'found' ELSE 'idle' END AS state FROM o""")
def quarantine_health(spark, sf):
    events = table(spark, sf, "events")
    n, kind = F.col("event_id"), F.col("event_type")
    op = F.when(kind.isin("view", "error"), "quarantine").when(kind == "click", "restore").otherwise("skip")
    journal = events.select(n.alias("seq"), (F.col("user_id") % 10).alias("plan_id"), (n % 2000).alias("item_id"), op.alias("op"), F.when(n % 3 == 0, "started").otherwise("done").alias("status"))
    details = events.select(n.alias("seq"), F.when(n % 401 > 0, F.col("ts")).alias("completed_at"), (n % 977).alias("bytes"), F.timestamp_add("HOUR", -(n % 100).cast("int"), "ts").alias("mtime"))
    purges = events.where("event_id % 17 = 0").select(n.alias("seq"), F.lit("done").alias("status"))
    row = health.quarantine(journal, details, purges, F.lit(events.count() // 3))
    told = health.can_empty(row, F.lit("2024-06-01").cast("timestamp_ntz"))
    whole = told.select("*", F.lit(True).alias("healthy"), F.col("truncated").alias("has_error"), F.lit(0).alias("roots_missing"), F.lit(0).alias("problems"), F.lit(0).alias("proposed_plans"), F.col("items").alias("ready"), F.lit(False).alias("watching"))
    return health.state(whole).select(*told.columns, "state")


# --- fields, names that are free, proposals that are old, names of secrets ---

#: key, order, aliases, autocomplete token, sensitivity.
_KEYS = (
    ("ring", 0, ["Ring", "red ring"], "name", "normal"), ("bolt", 1, ["bolt", "fastener"], "tel", "normal"), ("small", 2, ["small", "size"], None, "sensitive"),
    ("blue", 3, ["blue", "b"], "email", "sensitive"), ("red", 4, ["red", "color"], "url", "normal"), ("widget", 5, ["widget", "large widget"], None, "secret"),
)
_TOKENS = ["section-a name", "tel", "off email", "nope", "", "url shipping"]
_ALIASES_SQL = ", ".join(f"('{key}', {n}, '{alias.lower().replace(' ', '')}')" for key, n, aliases, *_ in _KEYS for alias in aliases)
_KEYS_SQL = ", ".join(f"('{key}', {n}, {_spelled(token)}, {str(kind != 'normal').lower()})" for key, n, _, token, kind in _KEYS)


@query(f"""WITH a(key, ord, alias) AS (VALUES {_ALIASES_SQL}), r(key, ord, token, sensitive) AS (VALUES {_KEYS_SQL}),
f AS (SELECT p_partkey AS field, unnest([CASE WHEN p_size % 3 = 0 THEN '' ELSE substr(p_name, 1, 3) END, upper(p_name) || ' (' || p_brand || ')', 'color: ' || p_brand]) AS via, unnest([0, 1, 2]) AS place FROM part WHERE p_partkey % 7 > 0),
h AS (SELECT f.field, f.place, f.via, a.key, a.alias, row_number() OVER (PARTITION BY f.field, f.place ORDER BY (a.alias <> norm), CASE WHEN a.alias = norm THEN 0 ELSE -length(a.alias) END, a.ord) AS best
  FROM (SELECT *, regexp_replace(lower(via), '[ :()#_]', '', 'g') AS norm FROM f) f JOIN a ON norm <> '' AND (a.alias = norm OR (contains(norm, a.alias) AND length(a.alias) >= 2))),
l AS (SELECT field, arg_min(key, place) AS key, arg_min(via, place) AS via FROM h WHERE best = 1 GROUP BY field),
t AS (SELECT p_partkey AS field, ({_TOKENS!r})[p_partkey % 6 + 1] AS autocomplete, p_size % 10 = 0 AS masked, CASE p_partkey % 6 WHEN 0 THEN 'ring' WHEN 1 THEN 'bolt' WHEN 2 THEN 'blue' WHEN 5 THEN 'red' END AS auto FROM part),
b AS (SELECT t.*, l.key AS lkey, l.via AS lvia, coalesce(l.key, t.auto) AS k, CASE WHEN l.key IS NOT NULL AND t.auto <> l.key THEN t.auto END AS conflict FROM t LEFT JOIN l ON l.field = t.field),
w AS (SELECT b.field, b.lkey, regexp_replace(lower(regexp_replace(b.lvia, '[(].*?[)]', ' ', 'g')), '[ :()#_]', '', 'g') AS norm FROM b WHERE lkey IS NOT NULL),
c AS (SELECT w.field, w.lkey, replace(any_value(norm), arg_max(alias, length(alias)), '~') AS rest FROM w JOIN a ON a.key = w.lkey AND contains(norm, alias) AND length(alias) >= 2 GROUP BY w.field, w.lkey),
o AS (SELECT c.field, string_agg(DISTINCT a.key, ',' ORDER BY a.key) AS other FROM c JOIN a ON a.key <> c.lkey AND contains(rest, a.alias) AND length(a.alias) >= 2 GROUP BY c.field),
d AS (SELECT b.*, coalesce(r.sensitive, false) AS sensitive, CASE WHEN r.sensitive AND masked THEN 'hidden words' WHEN r.sensitive AND o.other IS NOT NULL THEN 'also like ' || o.other WHEN r.sensitive AND conflict IS NOT NULL THEN 'autocomplete says ' || conflict END AS dropped FROM b LEFT JOIN r ON r.key = b.k LEFT JOIN o ON o.field = b.field)
SELECT field, CASE WHEN dropped IS NULL THEN k END AS key, CASE WHEN lkey IS NOT NULL THEN 2 WHEN auto IS NOT NULL THEN 1 ELSE 0 END AS layer, CASE WHEN lkey IS NOT NULL THEN lvia WHEN auto IS NOT NULL THEN autocomplete END AS via, conflict, NOT sensitive AND conflict IS NOT NULL AS needs_click, dropped FROM d""")
def matched_fields(spark, sf):
    registry = spark.createDataFrame(list(_KEYS), "key string, ord int, aliases array<string>, autocomplete string, sensitivity string")
    n, size, name, brand = (F.col(f"p_{x}") for x in ("partkey", "size", "name", "brand"))
    labels = F.array(F.when(size % 3 == 0, "").otherwise(F.substring(name, 1, 3)), F.concat(F.upper(name), F.lit(" ("), brand, F.lit(")")), F.concat(F.lit("color: "), brand))
    fields = table(spark, sf, "part").select(n.alias("field"), F.when(n % 7 > 0, labels).alias("labels"), F.element_at(F.lit(_TOKENS), (n % 6 + 1).cast("int")).alias("autocomplete"), (size % 10 == 0).alias("masked"))
    return lookups.match_fields(fields, registry)


@query("""WITH m AS (SELECT o_orderkey AS id, '/q/' || o_custkey % 400 AS path FROM orders WHERE o_orderkey % 3 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY id) AS nth FROM m),
t AS (SELECT DISTINCT '/q/' || o_custkey % 400 AS path, CAST(o_orderkey * 31 % 60 AS INTEGER) AS n FROM orders WHERE o_orderkey % 3 = 1),
f AS (SELECT p.path, list_filter(range(0, 10001), lambda i: NOT list_contains(coalesce(h.taken, []), i)) AS free FROM (SELECT DISTINCT path FROM m) p LEFT JOIN (SELECT path, list(n) AS taken FROM t GROUP BY path) h ON h.path = p.path)
SELECT id, k.path, k.path || CASE free[nth] WHEN 0 THEN '' WHEN 1 THEN '.restored' ELSE '.restored.' || free[nth] END AS target FROM k JOIN f ON f.path = k.path""")
def free_restores(spark, sf):
    orders, n = table(spark, sf, "orders"), F.col("o_orderkey")
    path = F.concat(F.lit("/q/"), (F.col("o_custkey") % 400).cast("string"))
    held = n * 31 % 60
    taken = orders.where(n % 3 == 1).select(F.concat(path, F.when(held == 0, "").when(held == 1, ".restored").otherwise(F.concat(F.lit(".restored."), held.cast("string")))).alias("path"))
    return lookups.free_targets(orders.where(n % 3 == 0).select(n.alias("id"), path.alias("path")), taken)


@query("SELECT o_orderkey AS plan FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey <> 7 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def stale_plans(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "proposed").otherwise("applied")
    plans = table(spark, sf, "orders").select(F.col("o_orderkey").alias("plan"), status.alias("status"), F.col("o_orderdate").alias("created_at"))
    begun = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("plan"))
    return lookups.stale_proposals(plans, begun, F.lit("1996-01-01").cast("timestamp_ntz"), 7).select("plan")


#: Names with a number, and why each marks a secret.
_SECRET_NAMES = (
    ("id_rsa", "the file is named id_rsa"), (".env", "the file is named .env"), ("prod#.env", "the file is an environment file (.env)"), (".env.local#", "the file is an environment file (.env)"), ("Server#.PEM", "the extension is .pem"),
    ("key#.kdbx", "the extension is .kdbx"), ("my password #.txt", "the name contains “password”"), ("password rules #.pdf", None), ("seed-phrase #.pdf", "the name contains “seed-phrase”"), ("密碼#.xlsx", "the name contains “密碼”"), ("密碼#.docx", None),
    ("ＴＯＫＥＮ#.csv", "the name contains “token”"), ("holiday #.jpg", None), ("monkey#.txt", None), ("keychain#.zip", "the name contains “keychain”"), ("api-key #.doc", "the name contains “api-key”"),
)


@query(f"WITH t(n, name, reason) AS (VALUES {', '.join(f'({n}, {_spelled(name)}, {_spelled(reason)})' for n, (name, reason) in enumerate(_SECRET_NAMES))}) SELECT doc_id, replace(name, '#', CAST(doc_id AS VARCHAR)) AS name, reason FROM documents JOIN t ON n = doc_id % {len(_SECRET_NAMES)}")
def secret_names(spark, sf):
    doc = F.col("doc_id")
    kind = F.element_at(F.lit([name for name, _ in _SECRET_NAMES]), (doc % len(_SECRET_NAMES) + 1).cast("int"))
    named = table(spark, sf, "documents").select("doc_id", F.replace(kind, F.lit("#"), doc.cast("string")).alias("name"))
    return named.select("doc_id", "name", secrets.by_name(F.col("name")).alias("reason"))


# --- filing ---

_KINDS = ["Lecture", "Homework", "Exam"]
_STORE_SQL = """st AS (SELECT c_custkey % 20 AS owner, 'course' AS kind, 'course' || c_custkey % 30 AS k, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE 'Kurs ' || c_custkey % 7 END AS v FROM customer WHERE c_custkey <= 60
  UNION ALL SELECT c_custkey % 20, 'file_kind', 'course' || c_custkey % 30 || chr(10) || 'Other', CASE WHEN c_custkey % 2 = 0 THEN 'Exam' ELSE 'Odd' END FROM customer WHERE c_custkey <= 60
  UNION ALL SELECT c_custkey % 20, 'rejected', c_custkey * 3 || chr(10) || 'Courses/Kurs ' || c_custkey % 7 || '/Exam', '' FROM customer)"""


@query(f"""WITH {_STORE_SQL},
m AS (SELECT o_orderkey AS item, o_custkey % 20 AS owner, CASE WHEN o_orderkey % 5 > 0 THEN 'COURSE ' || o_orderkey % 40 ELSE '' END AS model, 'course' || o_orderkey % 40 AS model_key, CASE WHEN o_orderkey % 4 < 3 THEN ['Lecture', 'Homework', 'Exam'][o_orderkey % 4 + 1] ELSE 'Other' END AS mkind, 'a phrase ' || o_orderkey % 6 AS phrase FROM orders),
k AS (SELECT lower(replace(name, ' ', '')) AS key, min(name) AS spelled FROM (SELECT 'Course ' || p_size AS name FROM part UNION SELECT 'cOURSE ' || p_size FROM part WHERE p_size % 2 = 0 UNION SELECT 'KURS ' || p_size FROM part WHERE p_size % 2 = 1) GROUP BY 1),
g(phrase, folder) AS (VALUES ('a phrase 0', 'Zero things'), ('a phrase 1', 'courses'), ('a phrase 2', '')),
j AS (SELECT m.*, c.v AS pref, f.v AS kpref, g.folder AS gfolder, model <> '' AND trim(c.v) <> '' AND lower(replace(c.v, ' ', '')) <> model_key AS taught FROM m LEFT JOIN st c ON c.owner = m.owner AND c.kind = 'course' AND c.k = model_key AND model <> '' LEFT JOIN st f ON f.owner = m.owner AND f.kind = 'file_kind' AND f.k = model_key || chr(10) || mkind AND model <> '' LEFT JOIN g ON g.phrase = m.phrase),
w AS (SELECT j.*, CASE WHEN coalesce(taught, false) THEN pref ELSE model END AS want, CASE WHEN kpref = 'Exam' THEN 'Exam' WHEN kpref IS NOT NULL THEN 'Other' ELSE mkind END AS kind2 FROM j),
o AS (SELECT w.item, w.owner, CASE WHEN model = '' THEN '' ELSE coalesce(a.spelled, want) END AS course, kind2 AS kind, coalesce(taught, false) AS learned_course, kind2 <> mkind AS learned_kind, CASE WHEN taught THEN b.spelled END AS old, w.gfolder, w.model FROM w LEFT JOIN k a ON a.key = lower(replace(want, ' ', '')) LEFT JOIN k b ON b.key = model_key),
z AS (SELECT item, owner, course, kind, CASE WHEN model <> '' THEN 'Courses/' || course || '/' || kind WHEN gfolder <> '' AND lower(gfolder) <> 'courses' THEN gfolder END AS folder, learned_course, learned_kind, old AS also_known_as FROM o)
SELECT z.*, EXISTS (SELECT 1 FROM st WHERE st.owner = z.owner AND st.kind = 'rejected' AND st.k = z.item || chr(10) || z.folder) AS was_rejected FROM z""")
def filing_offers(spark, sf):
    n, c = F.col("o_orderkey"), F.col("c_custkey")

    def number(x):
        return x.cast("string")

    customers = table(spark, sf, "customer")
    owner, taught = (c % 20).alias("owner"), customers.where("c_custkey <= 60")
    key = F.concat(F.lit("course"), number(c % 30))
    kurs = F.concat(F.lit("Kurs "), number(c % 7))
    store = taught.select(owner, F.lit("course").alias("kind"), key.alias("k"), F.when(c % 4 == 0, " ").otherwise(kurs).alias("v"))
    store = store.unionByName(taught.select(owner, F.lit("file_kind").alias("kind"), F.concat_ws("\n", key, F.lit("Other")).alias("k"), F.when(c % 2 == 0, "Exam").otherwise("Odd").alias("v")))
    store = store.unionByName(customers.select(owner, F.lit("rejected").alias("kind"), F.concat_ws("\n", number(c * 3), F.concat(F.lit("Courses/"), kurs, F.lit("/Exam"))).alias("k"), F.lit("").alias("v")))
    size = F.col("p_size")
    spelled = F.array(F.concat(F.lit("Course "), number(size)), F.when(size % 2 == 0, F.concat(F.lit("cOURSE "), number(size))).otherwise(F.concat(F.lit("KURS "), number(size))))
    folders = table(spark, sf, "part").select(F.explode(spelled).alias("name")).distinct()
    groups_ = spark.createDataFrame([("a phrase 0", "Zero things"), ("A  Phrase 1", "courses"), ("a phrase 2", "")], "phrase string, folder string")
    kind = F.element_at(F.lit([*_KINDS, "what"]), (n % 4 + 1).cast("int"))
    opinions = table(spark, sf, "orders").select(n.alias("item"), (F.col("o_custkey") % 20).alias("owner"), F.when(n % 5 > 0, F.concat(F.lit("COURSE "), number(n % 40))).alias("course"), kind.alias("kind"), F.concat(F.lit("a phrase "), number(n % 6)).alias("phrase"))
    return filing.offered(opinions, store, folders, groups_, _KINDS)


@query("SELECT o_orderkey AS id FROM orders o WHERE o_orderstatus <> 'P' AND o_orderkey % 9 > 0 AND (o_orderkey % 10 = 0 OR (o_custkey % 3 > 0 AND EXISTS (SELECT 1 FROM orders v WHERE v.o_orderkey % 10 = 0 AND v.o_custkey = o.o_custkey)))")
def filable_files(spark, sf):
    n, who = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "missing").otherwise("candidate")
    items = orders.select(n.alias("id"), F.when(who % 3 > 0, F.concat(F.lit("sha"), who.cast("string"))).alias("sha256"), status.alias("status"), F.when(n % 9 == 0, "unreadable").alias("error"))
    views = orders.where(n % 10 == 0).select(n.alias("item"))
    return filing.filable(items, views.unionByName(views)).select("id")
