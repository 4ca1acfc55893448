"""Typed validation of values against a registry of keys: every problem of a row, in one Column.

``registry(key, type, allowed, repeatable, sensitivity)`` says what a key holds; a value comes back in
the form of its type or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.functions import text, values

#: Registries up to this many keys are broadcast.
BROADCAST_KEYS = 100_000
# What an email address looks like, and numbers as they may be written.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def asserted_unique(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, whose plan fails where two of them have the same ``key``; no key is looked at on the driver."""
    others = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.count("*").alias("__n"), F.first(F.struct(*others)).alias("__row"))
    checked = F.when(F.col("__n") == 1, F.col("__row")).otherwise(F.raise_error(F.concat(F.lit(f"{key} is there more than once: "), F.col(key).cast("string"))))
    return one.select(key, checked.alias("__row")).select(key, "__row.*").select(*rows.columns)


def alias_index(registry: DataFrame, aliases: str, key: str, order: str) -> DataFrame:
    """``(alias, key)``: each alias once, in the form that labels are compared by; the first key in ``order`` has it."""
    listed = registry.select(key, order, F.explode(aliases).alias("alias")).withColumn("alias", text.match_key(F.col("alias")))
    return listed.where("alias <> ''").groupBy("alias").agg(F.min_by(key, F.struct(order, key)).alias(key))


def number(raw: Column) -> Column:
    """A written number as a double, full-width digits and all; null if it is none or not finite."""
    half = text.to_half_width(raw)
    made = F.when(half.rlike(NUMBER), half.cast("double"))
    return F.when(F.abs(made) < float("inf"), made)


def number_for_field(raw: Column) -> Column:
    """What a number field takes: digits, sign and point without separators and units; null if that is no number."""
    bare = F.regexp_replace(text.to_half_width(raw), r"[,\s_]", "")
    found = F.regexp_extract(bare, r"^[^0-9.+-]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))[^0-9]*$", 1)
    return F.when(found != "", found)


def normalised(kind: Column, raw: Column, allowed: Column) -> Column:
    """The value in the form of its type as text, or null: dates, months, phones, addresses, choices, numbers, truth, text."""
    trimmed = F.regexp_replace(raw, rf"^[{text.BLANKS}]+|[{text.BLANKS}]+$", "")
    day, email, half, plain = values.to_date(trimmed), F.lower(text.fold_full_width(trimmed)), text.to_half_width(trimmed), number(trimmed)
    address = F.coalesce(_url(trimmed), _url(text.fold_full_width(trimmed)))
    whole = (plain == F.floor(plain)) & (F.abs(plain) < 1e15)
    told = (
        F.when(kind == "date", F.when(F.length(day) == 10, day)).when(kind == "month", F.substring(day, 1, 7)).when(kind == "tel", values.to_e164(trimmed))
        .when(kind == "email", F.when(email.rlike(EMAIL), email)).when(kind == "url", address).when(kind == "enum", F.when(F.array_contains(allowed, half), half))
        .when(kind == "number", F.when(whole, plain.cast("long").cast("string")).otherwise(plain.cast("string"))).when(kind == "boolean", F.lit("true"))
        .when(kind == "text", trimmed).otherwise(half)
    )
    return F.when(trimmed != "", told)


def _url(raw: Column) -> Column:
    """A URL with a scheme and a host, both in lower case, and a path; null otherwise."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#\s]*)(\S*)$"
    scheme, host, path, rest = (F.regexp_extract(raw, pattern, n) for n in (1, 2, 3, 4))
    made = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(path == "", "/").otherwise(path), rest)
    return F.when(raw.rlike(pattern) & raw.rlike(r"^\p{ASCII}*$"), made)


def vetted(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """``facts(key, value, ...)`` with key_def, idx, normal, sensitivity and problems (array<string>).

    problems is empty where the fact may be stored, and names all that stands against it: unknown key,
    needs an index, takes no index, secret, empty, or what the value is not. normal is null then. A
    registry with a key twice fails the query; columns of facts with one of these names are replaced.
    """
    own = ("key_def", "idx", "normal", "sensitivity", "problems")
    rows = facts.drop(*own)
    known = asserted_unique(registry.select(F.col("key").alias("__def"), F.col("type").alias("__type"), F.col("allowed").alias("__allowed"), F.col("repeatable").alias("__repeatable"), F.col("sensitivity").alias("__sensitivity")), "__def")
    if registry.count() <= BROADCAST_KEYS:
        known = F.broadcast(known)
    key = F.col("key")
    parsed = rows.withColumn("__key", F.regexp_replace(key, r"\[\d+\]", "[]")).withColumn("__idx", F.when(key.rlike(r"\[\d+\]"), F.regexp_extract(key, r"\[(\d+)\]", 1).cast("int")))
    joined = parsed.join(known, F.col("__key") == F.col("__def"), "left").withColumn("__normal", normalised(F.col("__type"), F.col("value"), F.col("__allowed")))
    there, repeats, indexed = F.col("__def").isNotNull(), F.col("__repeatable"), F.col("__idx").isNotNull()
    empty = F.coalesce(F.regexp_replace("value", rf"[{text.BLANKS}]", "") == "", F.lit(True))
    tests = [
        ("unknown key", ~there), ("needs an index", there & repeats & ~indexed), ("takes no index", there & ~repeats & indexed),
        ("secret", there & (F.col("__sensitivity") == "secret")), ("empty", there & empty),
    ]
    wrong = F.when(there & ~empty & F.col("__normal").isNull(), F.concat(F.lit("not of type "), F.col("__type")))
    problems = F.array_compact(F.array(*(F.when(F.coalesce(holds, F.lit(False)), name) for name, holds in tests), wrong))
    return joined.select(*rows.columns, F.col("__key").alias("key_def"), F.col("__idx").alias("idx"), F.when(F.size(problems) == 0, F.col("__normal")).alias("normal"), F.col("__sensitivity").alias("sensitivity"), problems.alias("problems"))
