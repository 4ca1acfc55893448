"""File rules as data: each is a kind, a reason and a predicate over a catalogue row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.functions.values import age_days

# Confidences, extensions, name prefixes and limits of the rules.
CONFIDENCE = {"duplicate": 98, "same-text": 45, "partial": 95, "empty": 95, "temp": 85, "installer": 70, "archive": 65, "old-download": 35, "screenshot-noise": 35}
PARTIAL = (".crdownload", ".part", ".partial", ".download", ".opdownload", ".filepart")
TEMP = (".tmp", ".temp")
INSTALLER = (".dmg", ".pkg", ".msi", ".exe")
ARCHIVE = (".zip", ".rar", ".7z", ".tar", ".gz", ".tgz")
PROTECTED = (".pages", ".numbers")
SCREENSHOT = r"(?i)^(screenshot|screen shot|截圖|螢幕擷取|螢幕快照)[\s_\-（(]*"
REFUSED_ENDINGS = (".db", ".sqlite", ".sqlite3", ".pem", ".key", ".p12", ".pfx", ".ini", ".cfg", ".conf", ".lnk", ".url")
REFUSED_FOLDERS = (
    ".ssh", ".gnupg", ".aws", ".kube", ".config", ".git", "ssh", "gnupg", "keychain", "keychains",
    "credentials", "credential", "secrets", "secret", "tokens", "token",
)
REFUSED_FILES = (".env", ".npmrc", ".netrc", "id_rsa", "id_ed25519", "id_ecdsa", "id_dsa", "data.db")
PROTECT_DAYS, CHECKED_FROM, RULE_VERSION = 14, 50, "1"
LIVE = ("new", "candidate", "kept", "restored")


@dataclass(frozen=True)
class Rule:
    kind: str
    reason: str
    applies: Column


def rules(protect_days: float | None = PROTECT_DAYS) -> list[Rule]:
    """The rules in their fixed order; a protect_days that isn't positive falls back to the default."""
    days = protect_days if isinstance(protect_days, (int, float)) and protect_days > 0 else PROTECT_DAYS
    age, ext, size = F.col("age"), F.col("ext"), F.col("bytes")
    return [
        Rule("partial", "unfinished download", ext.isin(*PARTIAL) & (age >= 1)),
        Rule("empty", "empty file", (size == 0) & (age >= 1)),
        Rule("temp", "temporary file", (size > 0) & ext.isin(*TEMP) & (age >= 7)),
        Rule("installer", "old installer", ext.isin(*INSTALLER) & (age >= 14)),
        Rule("archive", "old archive", ext.isin(*ARCHIVE) & (age >= 30)),
        Rule("old-download", "not touched for long", ~ext.isin(*PROTECTED) & (age >= days)),
        Rule("screenshot-noise", "old screenshot", F.col("name").rlike(SCREENSHOT) & (age >= 30)),
    ]


def refuses_name(name: Column) -> Column:
    """Whether a file must never be touched because of its name."""
    low = F.lower(name)
    return low.startswith(".") | low.isin(*REFUSED_FOLDERS) | refuses_file(low) | reduce(or_, (low.endswith(x) for x in REFUSED_ENDINGS))


def refuses_file(low: Column) -> Column:
    """Whether a lower-case name is one of the refused files, alone or with more endings."""
    return low.isin(*REFUSED_FILES) | reduce(or_, (low.startswith(f"{x}.") for x in REFUSED_FILES))


def candidates(catalogue: DataFrame, now: Column, protect_days: float | None = PROTECT_DAYS) -> DataFrame:
    """``(item_id, kind, confidence, reason, age)``: every rule that applies, none for refused names."""
    aged = catalogue.withColumn("age", age_days(F.col("mtime"), now)).where(~refuses_name(F.col("name")))
    drafts = F.array_compact(F.array(*(F.when(r.applies, F.struct(F.lit(r.kind).alias("kind"), F.lit(CONFIDENCE[r.kind]).alias("confidence"), F.lit(r.reason).alias("reason"))) for r in rules(protect_days))))
    return aged.select(F.col("id").alias("item_id"), "age", F.explode(drafts).alias("d")).select("item_id", "d.*", "age")


def top_candidate(found: DataFrame) -> DataFrame:
    """One row per item: its most confident candidate (then by kind), and whether it starts checked."""
    best = found.groupBy("item_id").agg(F.min_by(F.struct("kind", "confidence"), F.struct(-F.col("confidence"), "kind")).alias("best"), F.count("*").alias("n_kinds"))
    return best.select("item_id", "best.kind", "best.confidence", "n_kinds", (F.col("best.confidence") >= CHECKED_FROM).alias("checked"))


def totals(listing: DataFrame, shown: int) -> DataFrame:
    """One row: counts and bytes of all checked items, and bytes of the ``shown`` first listed."""
    top = listing.orderBy(F.desc("confidence"), "kind", "item_id").limit(shown).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("shown_bytes"))
    whole = listing.agg(F.count("*").alias("n_items"), F.count_if("checked").alias("n_checked"), F.coalesce(F.sum(F.when(F.col("checked"), F.col("bytes"))), F.lit(0)).alias("checked_bytes"))
    return whole.crossJoin(F.broadcast(top)).withColumn("truncated", F.col("n_items") > shown)  # one row each
