"""From files to opinions: who is pending, who may be asked about, whom the cache knows, who is asked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.functions import secrets
from filewright.functions.text import long_enough
from filewright.functions.values import view_key

# The fields of an answer and what two of them may say.
FIELDS = ("course", "topic", "kind", "suggested_name", "what_it_is", "subject", "evidence", "confidence")
CONFIDENCES = ("high", "medium", "low")
PAYLOAD_CHARS = 2000


def parse_view(raw: Column) -> Column:
    """struct of eight strings; null unless the answer has exactly those, all strings, and a known confidence."""
    view = F.from_json(raw, ", ".join(f"{f} string" for f in FIELDS), {"allowUnquotedControlChars": "true"})
    keys = F.json_object_keys(raw)
    kinds = F.transform(F.map_values(F.from_json(raw, "map<string,string>", {"allowUnquotedControlChars": "true"})), lambda x: x.isNotNull())
    strings = F.size(F.regexp_extract_all(raw, F.lit(r'"(' + "|".join(FIELDS) + r')"\s*:\s*"'), F.lit(1))) == len(FIELDS)
    whole = (F.array_size(keys) == len(FIELDS)) & (F.size(F.array_intersect(keys, F.array(*map(F.lit, FIELDS)))) == len(FIELDS))
    return F.when(F.coalesce(whole & strings & F.forall(kinds, lambda x: x) & view["confidence"].isin(*CONFIDENCES), F.lit(False)), view)


def blocked(items: DataFrame, own_key: str | None = None) -> DataFrame:
    """``(item_id, why)`` of the items whose name or text holds a secret."""
    return items.select("item_id", secrets.screen(F.col("name"), F.col("text"), own_key).alias("why")).where("why is not null")


def payloads(items: DataFrame, version: str) -> DataFrame:
    """``(item_id, key, payload)`` of the items with enough text; equal payloads share a key."""
    head = F.substring("text", 1, PAYLOAD_CHARS)
    return items.where(long_enough(F.col("text"))).select("item_id", view_key(head, version).alias("key"), head.alias("payload"))


def asked(wanted: DataFrame, cache: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """``(key, raw)``: the answers to the payloads that the cache doesn't hold, each asked once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "raw": [ask(x) for x in frame["payload"]]}, dtype=object)

    new = wanted.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    return new.select("key", "payload").mapInPandas(run, "key string, raw string")


def think_round(items: DataFrame, cache: DataFrame, ask: Callable[[str], str], version: str, own_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(cache with the new views, links (item_id, key))`` of one round over ``items``.

    ``items`` is ``(item_id, name, text)``, ``cache`` ``(key, view)``. Answers that don't parse are
    not kept, so their items stay pending; twins of an answered payload are linked as well.
    """
    open_items = items.join(blocked(items, own_key).select("item_id"), "item_id", "left_anti")
    wanted = payloads(open_items, version)
    new = asked(wanted, cache, ask).select("key", parse_view(F.col("raw")).alias("view")).where("view is not null")
    held = cache.select("key", "view").unionByName(new)
    return held, wanted.join(held.select("key"), "key", "left_semi").select("item_id", "key")


def for_form(keys: DataFrame, registry: DataFrame, facts: DataFrame) -> DataFrame:
    """``(key, action, value)``: what to do with each asked key of a form.

    unknown keys are not in the registry; composed ones come from others; several current values
    are to be picked from; sensitive ones are confirmed each time; the rest is filled or missing.
    """
    current = facts.where("status = 'confirmed'").groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    met = keys.join(registry.withColumn("known", F.lit(True)), "key", "left").join(current, "key", "left")
    action = F.when(F.col("known").isNull(), "unknown").when(F.col("fill") == "compose", "compose").when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("n") > 1, "pick").when(F.col("sensitivity") == "high", "confirm-each-time").otherwise("fill")
    return met.select("key", action.alias("action"), F.when(action.isin("fill", "confirm-each-time"), F.col("value")).alias("value"))
