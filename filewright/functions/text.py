"""Text and file-name functions as Column builders."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FULL_ALNUM = "".join(chr(0xFF10 + i) for i in range(10)) + "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))
_HALF_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_FULL_ASCII = "".join(chr(0xFF01 + i) for i in range(94))
_HALF_ASCII = "".join(chr(0x21 + i) for i in range(94))

# The mark of a copy's name, the two sorts of it whole.
_COPY_MARK = r"(?:\s*\(\d{1,3}\)|\s+-\s+(?:copy|副本|複製|复制|複本)(?:\s*\(\d{1,3}\))?|\s+(?:copy|拷貝|拷贝|副本|的副本|複本)(?:\s+\d{1,3})?)"
COPY_NAME = rf"(?iu)^(?:copy of\s+\S.*|.*\S{_COPY_MARK}(?:\.[^.\s]{{1,8}}){{0,2}})$"
# Control and direction characters, white space of Unicode, what a form label may
# carry around its words, beginnings of absolute paths, prefixes of keys, and the marks for both.
CONTROLS = r"[\x00-\x1f\x7f-\x9f\x{61c}\x{200e}\x{200f}\x{2028}-\x{202e}\x{2066}-\x{2069}]"
PREVIEW_CONTROLS = r"[\x00-\x08\x0b-\x1f\x7f-\x9f\x{61c}\x{200e}\x{200f}\x{2028}-\x{202e}\x{2066}-\x{2069}]"
BLANKS = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
LABEL_NOISE = rf"[{BLANKS}:：*＊()（）\[\]【】<>《》.,、。_\-—/\\]"
PATHS = r"""(?:~|/(?:home|Users|var|tmp|private|etc|opt|mnt|media|root|srv|usr)|[A-Za-z]:)[\\/][^\s"'，。；：）】]*"""
KEY_PREFIXES = r"(?i)\b(?:sk|pk|rk|hf|ghp|gho|ghu|ghs|glpat|xox[abpsr])[-_][A-Za-z0-9._~+/=-]{12,}"
PATH_MARK, KEY_MARK, CONTROL_MARK = "⋯", "[hidden]", "·"


def to_half_width(text: Column) -> Column:
    """Full-width letters, digits and blank to ASCII; white space runs to one blank; trimmed."""
    half = F.translate(text, _FULL_ALNUM + "　", _HALF_ALNUM + " ")
    return F.trim(F.regexp_replace(half, r"\s+", " "))


def fold_full_width(text: Column) -> Column:
    """The whole full-width ASCII block to ASCII, blanks included; trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, _FULL_ASCII + "　", _HALF_ASCII + " "), r"\s+", " "))


def match_key(label: Column) -> Column:
    """What two form labels are compared by: half-width, no white space or punctuation, lower."""
    return F.lower(F.regexp_replace(F.translate(label, _FULL_ALNUM, _HALF_ALNUM), LABEL_NOISE, ""))


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition, for which Spark has no built-in; ASCII stays out of Python."""
    plain = text.rlike(r"^\p{ASCII}*$")
    return F.when(plain, text).otherwise(_composed(F.when(~plain, text)))


def phrase_key(phrase: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(nfkc(phrase), r"\s+", " ")))


def course_key(course: Column) -> Column:
    return F.lower(F.regexp_replace(nfkc(course), r"\s+", ""))


def looks_like_copy(name: Column) -> Column:
    """Whether a file name looks like a copy of another: "(1)", "- copy", "copy of ..."."""
    return F.coalesce(name.rlike(COPY_NAME), F.lit(False))


def strip_copy_suffix(name: Column) -> Column:
    """The name without its copy mark and with its extension; unchanged if nothing would be left."""
    lead = F.regexp_replace(name, r"(?i)^copy of\s+", "")
    stem = F.regexp_extract(name, r"^(.*?)((?:\.[^.\s]{1,8}){0,2})$", 1)
    extension = F.regexp_extract(name, r"^(.*?)((?:\.[^.\s]{1,8}){0,2})$", 2)
    bare = F.trim(F.regexp_replace(stem, rf"(?iu){_COPY_MARK}$", ""))
    stripped = F.when(name.rlike(r"(?i)^copy of\s+"), F.coalesce(F.nullif(lead, F.lit("")), name)).otherwise(F.when(bare != "", F.concat(bare, extension)).otherwise(name))
    return F.when(looks_like_copy(name), stripped).otherwise(name)


def original_ext(name: Column) -> Column:
    """The extension of up to ten letters and digits as it is spelled, packed ".tar" kinds whole; "" if none."""
    packed = r"(?i)(\.tar\.(?:gz|bz2|xz|zst|lz|lzma|z))$"
    return F.when(name.rlike(packed), F.regexp_extract(name, packed, 1)).otherwise(F.regexp_extract(name, r"(?s)^.+(\.[A-Za-z0-9]{1,10})$", 1))


def clean_field(text: Column, most: int) -> Column:
    """Controls to blanks, absolute paths to one mark, trimmed, at most ``most`` characters."""
    hidden = F.regexp_replace(F.regexp_replace(text, CONTROLS, " "), PATHS, PATH_MARK)
    return F.substring(F.regexp_replace(hidden, rf"^[{BLANKS}]+|[{BLANKS}]+$", ""), 1, most)


def safe_preview(text: Column) -> Column:
    """CRLF to LF, then every control but tab and newline to a middle dot."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), PREVIEW_CONTROLS, CONTROL_MARK)


def looks_like_text(text: Column, most: float = 0.02) -> Column:
    """Something but white space, and at most two in a hundred of the first 4096 characters are controls."""
    head = F.substring(text, 1, 4096)
    odd = F.length(head) - F.length(F.regexp_replace(head, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))
    return F.coalesce(text.rlike(rf"[^{BLANKS}]") & (odd <= F.length(head) * most), F.lit(False))


def long_enough(text: Column, least: int = 30) -> Column:
    return F.coalesce(F.length(F.trim(text)) >= least, F.lit(False))


def split_address(full: Column) -> Column:
    """struct(full, postal_code, city, district, rest); all but full are null if no city is found."""
    whole = to_half_width(full)
    shape = r"^(\d{3,5})?\s*(.{2,3}[市縣])(.{1,4}[區鄉鎮市])?(.*)$"
    part = lambda n: F.nullif(F.regexp_extract(whole, shape, n), F.lit(""))
    rest = F.when(whole.rlike(shape), F.trim(F.regexp_extract(whole, shape, 4)))
    return F.struct(whole.alias("full"), part(1).alias("postal_code"), part(2).alias("city"), part(3).alias("district"), rest.alias("rest"))


def hide_keys(text: Column) -> Column:
    """What looks like a key to a mark: known prefixes, and long runs of both cases and digits."""
    shown = F.regexp_replace(F.regexp_replace(text, CONTROLS, CONTROL_MARK), KEY_PREFIXES, KEY_MARK.replace("[", r"\["))
    run = "[A-Za-z0-9+/=_-]"
    return F.regexp_replace(shown, rf"(?<!{run})(?={run}*[a-z])(?={run}*[A-Z])(?={run}*[0-9]){run}{{32,}}", KEY_MARK.replace("[", r"\["))


def format_bytes(size: Column) -> Column:
    """1536 -> "1.5 KB"; whole bytes below 1024, two decimals from a gigabyte on."""
    scaled = lambda power, digits, unit: F.format_string(f"%.{digits}f {unit}", size / float(1024**power))
    small = F.concat(F.greatest(F.round(size), F.lit(0)).cast("long").cast("string"), F.lit(" B"))
    return F.when(size >= 1024**3, scaled(3, 2, "GB")).when(size >= 1024**2, scaled(2, 1, "MB")).when(size >= 1024, scaled(1, 1, "KB")).otherwise(small)


def display_path(path: Column, root: Column) -> Column:
    """The folder of ``path`` under ``root``: its last two parts, with an ellipsis if more."""
    inner = F.slice(F.split(F.substr(path, F.length(root) + 2), "/"), F.lit(1), F.size(F.split(F.substr(path, F.length(root) + 2), "/")) - 1)
    whole = F.concat(F.array(F.element_at(F.split(root, "/"), -1)), inner)
    return F.when(F.size(whole) > 2, F.concat(F.lit("…/"), F.array_join(F.slice(whole, -2, 2), "/"))).otherwise(F.array_join(whole, "/"))
