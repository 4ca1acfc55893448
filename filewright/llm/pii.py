"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Seeds are the matches of four fixed shapes. The words before a seed are its lexical patterns.
Other identifier-like tokens stand in patterns too, so patterns and instances form a graph: a
pattern is as good as the share of its instances that are known to be of one kind, an instance as
good as the patterns it stands in. Spark scores both in turn; confident patterns make known
instances, these raise further patterns, and every occurrence of a discovered instance is a span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filewright.llm._shared import stash

KINDS = ("email", "ip", "card", "phone")
#: Spans of a text are cut out with this character; in a text it counts as another control.
MARK, OTHER = "\x01", "\x02"

# The shapes. Possessive runs and a start at the edge of a run (or at the end of
# the match before) find the same leftmost matches without trying every place inside a run.
_LOCAL = "[A-Za-z0-9._%+-]"
SHAPES = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An identifier-like token: at least five characters between delimiters, with a digit, an underscore
#: or a dot between letters among them; or a number written in groups, with blanks or brackets.
_DELIMITERS = r"\s\x01\x22'<>(),;=|\[\]{}"
_GROUPS = r"(?:\([0-9]{2,}+\)|[0-9]{2,}+)(?:[\x20.-]{1,2}+(?:\([0-9]{2,}+\)|[0-9]{2,}+))++"
_HINT = rf"(?=[^{_DELIMITERS}0-9_]*+[0-9_]|[^{_DELIMITERS}]*?[A-Za-z]\.[A-Za-z])"
TOKEN = rf"(?<![^{_DELIMITERS}])(?:{_GROUPS}(?![^{_DELIMITERS}.])|{_HINT}[^{_DELIMITERS}]{{5,}}+)"
LIKE_TOKEN = r"[0-9_]|[A-Za-z]\.[A-Za-z]"

#: A pattern is the last words, so many of them, within so many characters before an occurrence.
CONTEXT, WORDS = 80, (1, 2, 3)
#: Characters of the blocks out of which a redacted text is put together.
BLOCK = 4096
#: A pattern is confident with this many known instances at least, and this share of all its own.
SUPPORT, PRECISION = 5, 0.8
#: An instance is known when one minus the product of its patterns' doubts reaches this.
CONFIDENCE = 0.9


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    """Whether a match of a shape is an identifier of its kind."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _parts(text: Column, shape: str) -> Column:
    """The text cut at the matches of a shape: gap, match, gap, ..., match, gap."""
    return F.split(F.regexp_replace(F.translate(text, MARK, OTHER), f"({shape})", f"{MARK}$1{MARK}"), MARK)


def _matches(text: Column, kind: str, shape: str) -> Column:
    def of(parts: Column) -> Column:
        one = lambda i: F.struct(
            F.lit(kind).alias("kind"),
            i.cast("int").alias("pos"),
            F.length(F.get(parts, 2 * i)).alias("gap"),
            F.get(parts, 2 * i + 1).alias("value"),
            F.right(F.get(parts, 2 * i), F.lit(CONTEXT)).alias("left"),
        )
        none = F.array().cast("array<struct<kind:string,pos:int,gap:int,value:string,left:string>>")
        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), one)).otherwise(none)

    return F.flatten(F.transform(F.array(_parts(text, shape)), of))  # the one-element array binds the parts once


def occurrences(docs: DataFrame, numbered: bool = False) -> DataFrame:
    """``(uid, doc_id, kind, start, end, value, left, base)``: all matches and other tokens.

    A row without any has one row of nulls, so that no document is lost. uid is a number of the row,
    that of ``docs`` if it is ``numbered``. Other tokens have kind token; those that overlap a base span are left out, as are matches that fail.
    """
    text = F.coalesce("text", F.lit(""))
    marks = {"email": text.contains("@"), "phone": text.contains("+"), "token": text.rlike(LIKE_TOKEN)}
    each = (F.when(marks.get(kind, text.rlike("[0-9]")), _matches(text, kind, SHAPES.get(kind, TOKEN))).otherwise(F.array()) for kind in (*KINDS, "token"))
    found = F.flatten(F.array(*each))
    # the number comes first: in one step with the explode it would number the exploded rows
    uid = F.col("uid") if numbered else F.monotonically_increasing_id().alias("uid")
    rows = docs.select(uid, "doc_id", "text").select("uid", "doc_id", F.explode_outer(found).alias("x")).select("uid", "doc_id", "x.*")
    rows = stash(rows, "pii-matches")
    before = Window.partitionBy("uid", "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.length("value")).over(before)
    placed = rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("value"))
    passes = F.lit(False)
    for kind in KINDS:
        passes = F.when(F.col("kind") == kind, valid(kind, F.col("value"))).otherwise(passes)
    placed = placed.withColumn("base", F.coalesce(passes, F.lit(False)))
    # both frames only grow, so a document's matches cost no more than their sorting
    order = ("start", "end", "kind", "pos")
    ahead_of = Window.partitionBy("uid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("uid").orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(ahead_of)
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(behind)
    clear = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    # a token that starts where a base span does is caught by the second test or by the tie in order
    kept = placed.withColumn("clear", clear)
    token = (F.col("kind") == "token") & F.col("clear")
    return kept.select("uid", "doc_id", F.when(F.col("base") | token, F.col("kind")).alias("kind"), "start", "end", "value", "left", "base")


def _patterns() -> Column:
    """The last words before an occurrence on its line, with digits made alike."""
    line = F.lower(F.regexp_replace(F.regexp_extract("left", r"([^\r\n]*)$", 1), "[0-9]", "0"))
    words = F.filter(F.split(line, r"[\s\x01\x02]+"), lambda x: x != "")
    return F.flatten(F.transform(F.array(words), lambda w: F.array(*(F.when(F.size(w) >= k, F.concat_ws(" ", F.slice(w, F.size(w) - k + 1, k))) for k in WORDS))))


def discover(found: DataFrame) -> DataFrame:
    """``(value, kind)``: tokens that confident patterns show to be identifiers of a kind."""
    edges = found.where("kind is not null").select("value", F.when(F.col("base"), F.col("kind")).alias("seed"), F.explode(F.array_compact(_patterns())).alias("pattern"))
    edges = stash(edges.distinct(), "pii-edges")
    # only patterns with enough seeds can ever start a chain, and only unseeded values can be found
    known = edges.where("seed is not null").select("value", F.col("seed").alias("kind")).distinct()
    new = None
    while True:  # each round knows more values than the one before, so this ends
        told = edges.join(known, "value", "left")
        sizes = told.groupBy("pattern").agg(F.count_distinct("value").alias("all"))
        scored = told.where("kind is not null").groupBy("pattern", "kind").agg(F.count_distinct("value").alias("known")).where(F.col("known") >= SUPPORT)
        confident = scored.join(sizes, "pattern").withColumn("precision", F.col("known") / F.col("all")).where(F.col("precision") >= PRECISION).select("pattern", "kind", "precision")
        doubt = F.sum(F.log(F.greatest(1 - F.col("precision"), F.lit(0.02))))
        reached = edges.where("seed is null").join(known.select("value"), "value", "left_anti").join(confident, "pattern").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score"))
        best = reached.where(F.col("score") >= CONFIDENCE).groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        best = stash(best, "pii-found")
        new = best if new is None else new.unionByName(best)
        if best.isEmpty():
            return new
        known = known.unionByName(best)


def spans(docs: DataFrame, numbered: bool = False) -> DataFrame:
    """``(uid, doc_id, kind, start, end, base)`` of every span, and a row of nulls without any.

    Starts count code points. A null text is empty; repeated rows are rows of their own; a null
    doc_id is kept; other columns are ignored; an empty table gives no rows.
    """
    found = stash(occurrences(docs, numbered), "pii-occurrences")
    known = discover(found).withColumnRenamed("kind", "found")
    told = found.join(known, "value", "left")
    kind = F.when(F.col("base"), F.col("kind")).when(F.col("kind") == "token", F.col("found"))
    return told.select("uid", "doc_id", kind.alias("kind"), F.when(kind.isNotNull(), F.col("start")).alias("start"), F.when(kind.isNotNull(), F.col("end")).alias("end"), F.when(kind.isNotNull(), F.col("base")).alias("base"))


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(items), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _item(condition: Column) -> Column:
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return F.collect_list(F.when(condition & F.col("kind").isNotNull(), F.struct("start", order.alias("order"), "kind", "end")))


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, counts of base spans by kind, base and all spans as text."""
    by_row = spans(docs).groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"),
        *(F.count_if((F.col("kind") == kind) & F.col("base")).alias(f"n_{kind}") for kind in KINDS),
        _joined(_item(F.col("base"))).alias("base_spans"),
        _joined(_item(F.lit(True))).alias("spans"),
    )
    return by_row.drop("uid")


def _between(start: Column, stop: Column) -> Column:
    """The text from ``start`` to ``stop``, out of its blocks: a place far into a text is slow to find."""
    first = F.floor(start / BLOCK).cast("int")
    blocks = F.slice("blocks", first + 1, F.floor(stop / BLOCK).cast("int") - first + 1)
    return F.substring(F.array_join(blocks, ""), (start - first * BLOCK + 1).cast("int"), (stop - start).cast("int"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with every span replaced by its kind in angle brackets.

    Overlapping spans become one mark, of the first. A row without spans is returned as it is, a
    null text as null; repeated rows stay, an empty table gives no rows, and columns of any name
    are returned as they are.
    """
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    rows = stash(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", others), "pii-rows")
    found = spans(rows.select("uid", "doc_id", "text"), numbered=True).where("kind is not null")
    before = F.max("end").over(Window.partitionBy("uid").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1))
    found = found.select("uid", "start", "end", "kind", F.coalesce(before, F.lit(0)).alias("before"))
    one = F.struct("start", "before", "kind")
    listed = found.groupBy("uid").agg(F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("before"), one))).alias("spans"), F.max("end").alias("last"))
    length = F.length("text").cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(length / BLOCK).cast("int")), lambda i: F.substring(F.col("text"), i * BLOCK + 1, F.lit(BLOCK)))
    piece = lambda s: F.concat(_between(s["before"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
    marked = F.concat(F.array_join(F.transform("spans", piece), ""), _between(F.col("last"), length))
    told = rows.join(listed, "uid", "left").withColumn("blocks", F.when(F.col("spans").isNotNull(), blocks))
    redacted = F.when(F.col("spans").isNotNull(), marked).otherwise(F.col("text")).alias("text")
    return told.select(*(redacted if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
