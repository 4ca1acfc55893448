"""Building file and folder names: cleaned, capped, and free among those taken."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from filewright.functions.text import match_key

# What Windows reserves, and the limits of a name.
RESERVED = frozenset(["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))])
MAX_CHARS, MAX_BYTES, LAST_SUFFIX = 80, 250, 99
_DROPPED = re.compile("[\x00-\x1f\x7f-\x9f​-‏‪-‮⁦-⁩﻿<>:\"/\\\\|?*]")


def clean(name: str | None, ext: str | None) -> str:
    """One name without its extension, safe as a file name everywhere; "" if nothing is left.

    >>> clean(" a/b: report.pdf. ", ".pdf")
    'ab report'
    """
    text, before = unicodedata.normalize("NFC", name or ""), None
    while text != before:  # each step may uncover work for another
        before = text
        text = " ".join(_DROPPED.sub("", text).split()).strip(" .")
        if ext and text.lower().endswith(ext.lower()):
            text = text[: -len(ext)]
    text = cap(text, ext or "")
    return "" if text.lower().split(".")[0] in RESERVED else text


def cap(stem: str, ext: str, suffix: str = "") -> str:
    """The longest start of ``stem`` that fits with extension and suffix."""
    stem = stem[: max(0, MAX_CHARS - len(ext) - len(suffix))]
    room = MAX_BYTES - len((ext + suffix).encode())
    return stem.encode()[: max(0, room)].decode("utf-8", "ignore").rstrip(" .")


@F.pandas_udf(StringType())
def clean_name(names: pd.Series, exts: pd.Series) -> pd.Series:
    return pd.Series([clean(n, e) for n, e in zip(names, exts, strict=True)], dtype=object)


def free_name(stem: Column, ext: Column, taken: Column) -> Column:
    """The first of stem, stem-2 ... stem-99 that ``taken`` lower-case names don't hold; else null."""
    rest = F.transform(F.sequence(F.lit(2), F.lit(LAST_SUFFIX)), lambda n: F.concat(stem, F.lit("-"), n.cast("string"), ext))
    options = F.concat(F.array(F.concat(stem, ext)), rest)
    return F.get(F.filter(options, lambda x: ~F.array_contains(taken, F.lower(x))), 0)


def restore_target(path: Column, taken: Column, most: int = 10_000) -> Column:
    """The first of path, path.restored, path.restored.2 ... ``most`` that ``taken`` does not hold; else null.

    One of as many names as are taken, and one more, is free.
    """
    last = F.greatest(F.lit(2), F.least(F.lit(most), F.size(taken) + 1))
    rest = F.transform(F.sequence(F.lit(2), last), lambda n: F.concat(path, F.lit(".restored."), n.cast("string")))
    options = F.concat(F.array(path, F.concat(path, F.lit(".restored"))), rest)
    return F.get(F.filter(options, lambda x: ~F.array_contains(taken, x)), 0)


def strip_unknown(name: Column) -> Column:
    """Without up to eight leading parts that only say a course is unknown."""
    return F.regexp_replace(name, r"(?i)^(?:(?:unknown|n/?a|none|untitled|未知|不明)_){1,8}", "")


def pick_option(options: Column, want: Column) -> Column:
    """The one option of ``options(value, text, disabled)`` that matches, else null.

    By its value, by its text, by either as labels are compared, or by a text that contains what is
    wanted. The first of these that any option meets must single one out. Disabled options and
    those without a value take part only by an equal value or text.
    """
    key = match_key(want)
    same = lambda x: F.trim(x["text"]) == want
    real = lambda x: (~F.coalesce(x["disabled"], F.lit(False)) & (match_key(x["value"]) != "")) | same(x)
    tiers = (
        lambda x: x["value"] == want,
        same,
        lambda x: real(x) & (match_key(x["value"]) == key),
        lambda x: real(x) & (match_key(x["text"]) == key),
        lambda x: real(x) & (key != "") & F.contains(match_key(x["text"]), key),
    )
    out = F.when(want.isNull(), None)
    for tier in tiers:
        hits = F.filter(options, tier)
        out = out.when(F.size(hits) > 0, F.when(F.size(hits) == 1, F.get(hits, 0)))
    return out
