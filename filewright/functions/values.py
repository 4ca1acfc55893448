"""Dates, phone numbers, keys and hashes as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filewright.functions.text import fold_full_width

# The first year before year one of the Republic's calendar, and its country code.
ROC_OFFSET, ROC_YEARS, TW = 1911, (1, 200), "886"
ROC_DATE = r"(?:民國\s*)?(?<!\d)(\d{1,3})\s*年\s*(\d{1,2})\s*月(?:\s*(\d{1,2})\s*日)?"
ISO_DATE = r"^(\d{4})-(\d{2})(?:-(\d{2}))?$"
WESTERN_DATE = r"(?<!\d)(\d{4})\s*[年/\-.]\s*(\d{1,2})(?:\s*[月/\-.]\s*(\d{1,2}))?"


def age_days(then: Column, now: Column) -> Column:
    """Whole elapsed days, never negative; not calendar days."""
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(seconds / 86_400_000_000)).cast("long")


def _iso(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM or YYYY-MM-DD with months 1..12 and days 1..31, whatever the month; else null."""
    two = lambda x: F.lpad(x, 2, "0")
    good_month, no_day = month.cast("int").between(1, 12), day == ""
    with_day = F.when(F.nullif(day, F.lit("")).cast("int").between(1, 31), F.concat_ws("-", year, two(month), two(day)))
    return F.when(good_month, F.when(no_day, F.concat_ws("-", year, two(month))).otherwise(with_day))


def _parts(text: Column, shape: str) -> list[Column]:
    return [F.regexp_extract(text, shape, n) for n in (1, 2, 3)]


def roc_to_ad(raw: Column) -> Column:
    """A date of the Republic's calendar as YYYY-MM[-DD]; null if there is none."""
    text = fold_full_width(raw)
    year, month, day = _parts(text, ROC_DATE)
    number = F.nullif(year, F.lit("")).cast("int")
    return F.when(number.between(*ROC_YEARS), _iso((number + ROC_OFFSET).cast("string"), F.nullif(month, F.lit("")), day))


def to_date(raw: Column) -> Column:
    """Any known way to write a date as YYYY-MM or YYYY-MM-DD, as text; null if it isn't one."""
    text = fold_full_width(raw)
    iso, western = _parts(text, ISO_DATE), _parts(text, WESTERN_DATE)
    of = lambda p: _iso(p[0], F.nullif(p[1], F.lit("")), p[2])
    return F.when(text.rlike(ISO_DATE), of(iso)).when(text.rlike(WESTERN_DATE), of(western)).otherwise(roc_to_ad(raw))


def _tw(national: Column) -> Column:
    size = F.length(national)
    good = F.when(national.startswith("9"), size == 9).otherwise(size.isin(8, 9))
    return F.when(good, F.concat(F.lit(f"+{TW}"), national))


def _abroad(digits: Column) -> Column:
    return F.when(F.length(digits).between(7, 15), F.concat(F.lit("+"), digits))


def to_e164(raw: Column, country: str = TW) -> Column:
    """A phone number as +digits; null if its length is not one of its country's."""
    folded = fold_full_width(raw)
    digits = F.regexp_replace(folded, r"\D", "")
    after = lambda n: F.substr(digits, F.lit(n + 1))
    home = country == TW
    plus = F.when(digits.startswith(TW), _tw(after(len(TW)))).otherwise(_abroad(digits))
    local = _tw(after(1)) if home else _abroad(F.concat(F.lit(country), after(1)))
    coded = _tw(after(len(country))) if home else _abroad(digits)
    return F.when(digits == "", None).when(folded.startswith("+"), plus).when(digits.startswith("0"), local).when(digits.startswith(country), coded)


def phone_for_display(number: Column) -> Column:
    return F.regexp_replace(number, r"^\+886(9\d{2})(\d{3})(\d{3})$", "0$1-$2-$3")


def add_months_overflowing(then: Column, months: int) -> Column:
    """Months later with days past the month's end flowing into the next: Aug 31 + 6 is Mar 3."""
    first = F.add_months(F.trunc(then, "month"), months)
    return F.date_add(first, F.dayofmonth(then) - 1)


def expiry(confirmed: Column, policy: Column) -> Column:
    """When a fact goes stale: never (null), or six or twelve months after it was confirmed."""
    return F.when(policy == "6m", add_months_overflowing(confirmed, 6)).when(policy == "12m", add_months_overflowing(confirmed, 12))


def hamming(one: Column, two: Column) -> Column:
    return F.bit_count(one.bitwiseXOR(two))


def hex_to_long(text: Column) -> Column:
    """Sixteen hex digits as a signed long."""
    return F.conv(text, 16, -10).cast("long")


def view_key(payload: Column, version: str) -> Column:
    return F.concat(F.sha2(payload, 256), F.lit(f":{version}"))


def group_id(keeper: Column, members: Column) -> Column:
    """Sixteen hex digits that name a group by its keeper and its sorted members."""
    return F.substring(F.sha2(F.concat(keeper, F.lit("\n"), F.array_join(F.array_sort(members), ",")), 256), 1, 16)


def parse_key(key: Column) -> Column:
    """``a[3].b`` as struct(definition ``a[].b``, index 3)."""
    index = F.nullif(F.regexp_extract(key, r"\[(\d+)\]", 1), F.lit(""))
    return F.struct(F.regexp_replace(key, r"\[\d+\]", "[]").alias("definition"), index.cast("int").alias("idx"))
