"""URL filters whose lists change over time, as a temporal join of DataFrames.

Dated list entries become validity intervals; an as-of join evaluates every capture against the
entries that were active when it was fetched. An entry names a domain, with all below it, or a
path prefix of one host. A URL is matched by equality on its domain suffixes and path prefixes,
so no capture is compared with the whole list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filewright.llm._shared import stash

#: Intervals are broadcast up to this many, a few short strings each; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def host(url: Column) -> Column:
    """The lower-case host of a URL without port, user and final dot; null if there is none."""
    found = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.lower(F.rtrim(found, F.lit("."))), F.lit(""))


def path(url: Column) -> Column:
    """The path of a URL without query, fragment, empty parts and final slash."""
    found = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*(/[^?#]*)", 1)
    return F.rtrim(F.regexp_replace(found, "/+", "/"), F.lit("/"))


def intervals(events: DataFrame) -> DataFrame:
    """``(policy, key, since, until)`` of ``events(policy, entry, action, at)``.

    An add holds until the entry's next event of the same policy, a remove ends it; of events at
    the same moment a remove counts last. until is null while an entry is active. The host of an
    entry is lower-cased, its path is not; both lose a final slash or dot. Null or blank entries
    and those without a date drop out.
    """
    entry = F.trim("entry")
    domain = F.rtrim(F.lower(F.substring_index(entry, "/", 1)), F.lit("."))
    key = F.concat(domain, F.rtrim(F.regexp_replace(F.regexp_extract(entry, "(/.*)$", 1), "/+", "/"), F.lit("/")))
    clean = events.select("policy", key.alias("key"), "action", F.col("at").alias("since")).where("key != '' and since is not null and policy in ('block', 'allow')").distinct()
    later = Window.partitionBy("policy", "key").orderBy("since", "action")
    return clean.withColumn("until", F.lead("since").over(later)).where("action = 'add' and (until is null or until > since)").drop("action")


def keys(url: Column) -> Column:
    """Every key that an entry on this URL can have: domain suffixes, and host with path prefixes."""
    labels, parts = F.split(host(url), r"\."), F.split(path(url), "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(host(url), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host(url).isNotNull(), F.concat(domains, F.when(F.size(parts) >= 2, prefixes).otherwise(F.array().cast("array<string>"))))


def evaluate(captures: DataFrame, events: DataFrame, fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with blocked, policy, entry, since and n_active.

    Of the entries active at the fetch the longest decides, and an allow before a block of the
    same length; n_active counts them. A capture without a host or a date matches nothing and is
    not blocked; repeated captures stay, an empty table gives no rows; other columns are kept, those
    of the five names above are replaced.
    """
    told = ("blocked", "policy", "entry", "since", "n_active")
    kept = [c for c in captures.columns if c not in told]
    captures = captures.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col("url").alias("url"), F.col(f"`{fetched}`").alias("at"))
    active = stash(intervals(events), "url-intervals")
    if active.count() <= BROADCAST_ROWS:
        active = F.broadcast(active)
    # one URL fetched at one moment is looked up once, however many captures it has
    asked = captures.select(F.col("url").alias("__url"), F.col("at").alias("__at")).where("__url is not null and __at is not null").distinct()
    probes = asked.select("__url", "__at", F.explode(F.array_distinct(keys(F.col("__url")))).alias("key"))
    held = (F.col("since") <= F.col("__at")) & (F.col("until").isNull() | (F.col("__at") < F.col("until")))
    rank = F.struct(F.length("key"), F.col("policy") == "allow", "key")
    best = F.max_by(F.struct("policy", F.col("key").alias("entry"), "since"), rank).alias("best")
    verdicts = probes.join(active, "key").where(held).groupBy("__url", "__at").agg(best, F.count("*").alias("n_active")).select("__url", "__at", "best.*", "n_active")
    joined = captures.join(verdicts, (F.col("url") == F.col("__url")) & (F.col("at") == F.col("__at")), "left")
    columns = (F.col(f"row.`{c}`") for c in kept)
    return joined.select(*columns, F.coalesce(F.col("policy") == "block", F.lit(False)).alias("blocked"), "policy", "entry", "since", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"))
