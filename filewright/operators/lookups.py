"""Joins: what is still active, what is fresh, which answer wins, who is near, what an alias names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filewright.functions.text import match_key
from filewright.functions.values import hamming
from filewright.operators.sequences import micros

#: Rows of short strings that are broadcast at most.
BROADCAST_ROWS = 100_000


def without_later(rows: DataFrame, later: DataFrame, by: str, at: str) -> DataFrame:
    """Rows with no row of ``later`` of the same key after them.

    One aggregate per key replaces the inequality join: only the latest time can matter.
    """
    last = later.groupBy(by).agg(F.max(at).alias("__last"))
    return rows.join(last, by, "left").where(F.col("__last").isNull() | (F.col("__last") <= F.col(at))).drop("__last")


def without(rows: DataFrame, *done: DataFrame, by: str | list[str]) -> DataFrame:
    """Rows whose key is in none of ``done``; keys of ``done`` must not be null."""
    for other in done:
        rows = rows.join(other.select(by), by, "left_anti")
    return rows


def pending(items: DataFrame, answers: list[DataFrame], by: str, content_at: str, at: str) -> DataFrame:
    """Items that none of ``answers`` covers with an answer as new as their content."""
    for answer in answers:
        newest = answer.groupBy(by).agg(F.max(at).alias("__newest"))
        items = items.join(newest, by, "left").where(F.col("__newest").isNull() | (F.col("__newest") < F.col(content_at))).drop("__newest")
    return items


def first_answer(items: DataFrame, tiers: list[DataFrame], by: str, content_at: str) -> DataFrame:
    """``(by, tier, key, at)``: each item's answer from the first tier that has a fresh one.

    Within a tier the newest answer wins, then the smallest key. A tier is ``(by, key, at)``.
    """
    asked = items.select(by, F.col(content_at).alias("__content"))
    told = None
    for n, tier in enumerate(tiers):
        one = tier.select(by, F.lit(n).alias("tier"), "key", "at")
        told = one if told is None else told.unionByName(one)
    fresh = told.join(asked, by).where(F.col("at") >= F.col("__content"))
    best = fresh.groupBy(by).agg(F.min_by(F.struct("tier", "key", "at"), F.struct("tier", -micros("at"), "key")).alias("b"))
    return best.select(by, "b.*")


def within(rows: DataFrame, by: list[str], key: str, at: str, seconds: int, signature: str | None = None, most_bits: int = 10) -> DataFrame:
    """``(a, b, seconds_apart)``: pairs of one group at most ``seconds`` apart, a before b.

    Times are cut into buckets of that length, and each row looks into its own bucket and the one
    before, so the join is an equality; signatures, where given, must be within ``most_bits``.
    """
    width = seconds * 1_000_000
    keyed = rows.withColumn("__t", micros(at)).withColumn("__b", F.floor(F.col("__t") / width))
    right = keyed.select(*by, F.col("__b"), F.col(key).alias("b"), F.col("__t").alias("tb"), *([F.col(signature).alias("sb")] if signature else []))
    left = keyed.select(*by, F.explode(F.array("__b", F.col("__b") + 1)).alias("__b"), F.col(key).alias("a"), F.col("__t").alias("ta"), *([F.col(signature).alias("sa")] if signature else []))
    pairs = left.join(right, [*by, "__b"]).where((F.col("tb") - F.col("ta")).between(0, width) & ((F.col("ta") < F.col("tb")) | (F.col("a") < F.col("b"))))
    if signature:
        pairs = pairs.where(hamming(F.col("sa"), F.col("sb")) <= most_bits)
    return pairs.select("a", "b", ((F.col("tb") - F.col("ta")) / 1_000_000).alias("seconds_apart"))


def under_any(path: Column, roots: list[str]) -> Column:
    """Whether a path is one of ``roots`` or below one."""
    tests = [(path == r.rstrip("/")) | path.startswith(r.rstrip("/") + "/") for r in roots]
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def deepest_root(items: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """``items`` with root: the longest of ``roots(root)`` that holds the path, null if none does.

    A path's own prefixes are looked up by equality, so the list may be long.
    """
    parts = F.split("__path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    keyed = items.select(F.col(path).alias("__path")).distinct()
    known = roots.select(F.rtrim("root", F.lit("/")).alias("root")).distinct()
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    best = keyed.select("__path", F.explode(prefixes).alias("root")).join(known, "root").groupBy("__path").agg(F.max_by("root", F.length("root")).alias("root"))
    return items.join(best, F.col(path) == F.col("__path"), "left").drop("__path")


def alias_match(labels: DataFrame, registry: DataFrame, key: str, label: str) -> DataFrame:
    """``(key, name, exact)``: the registry entry that each label names.

    ``registry`` is ``(name, alias, ord)``, a small list of aliases that are compared as they are.
    An equal alias wins, then the longest that the label contains, then the registry's order.
    Distinct labels meet the aliases once; the list is broadcast, so its size is checked.
    """
    if registry.count() > BROADCAST_ROWS:
        raise ValueError(f"a registry has {BROADCAST_ROWS} aliases at most")
    texts = labels.select(label).where(F.col(label) != "").distinct()
    met = texts.join(F.broadcast(registry), F.col(label).contains(F.col("alias")))
    best = met.groupBy(label).agg(F.min_by(F.struct("name", (F.col("alias") == F.col(label)).alias("exact")), F.struct((F.col("alias") != F.col(label)), -F.length("alias"), "ord")).alias("b"))
    return labels.join(best, label).select(key, "b.*")


def active_errors(errors: DataFrame, successes: DataFrame, by: list[str], at: str) -> DataFrame:
    """The latest error of each key that no later success of the same key has cleared."""
    last = errors.groupBy(*by).agg(F.max(at).alias("failed_at"))
    good = successes.groupBy(*by).agg(F.max(at).alias("good_at"))
    return last.join(good, by, "left").where("good_at is null or good_at < failed_at").select(*by, "failed_at")


def listing_reason(listings: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """``(key, listed_in)``: the first listing, in the order given, that holds each item."""
    whole = None
    for n, (name, rows) in enumerate(listings):
        one = rows.select(key, F.lit(n).alias("__n"), F.lit(name).alias("listed_in"))
        whole = one if whole is None else whole.unionByName(one)
    return whole.groupBy(key).agg(F.min_by("listed_in", "__n").alias("listed_in"))


def row_rank(by: list[str], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def match_fields(fields: DataFrame, registry: DataFrame) -> DataFrame:
    """``(field, key, layer, via, conflict, needs_click, dropped)``: the registry key of each form field.

    ``fields(field, labels array<string>, autocomplete, masked)`` has unique fields; ``registry(key, ord,
    aliases array<string>, autocomplete, sensitivity)`` is a small list. The first label that names a key
    decides (layer 2): by an equal alias, then by the longest of two characters or more that it
    contains, then by the registry's order, all as labels are compared. Without one the last
    autocomplete token that a key has decides (layer 1), else layer is 0. conflict is the key that
    autocomplete names instead. A sensitive or secret key is dropped, with the reason, if the label has
    hidden words (masked), if what is left of it beside its longest alias is like another key, or on a
    conflict; another key with a conflict needs a click.
    """
    n = registry.count()
    if n > BROADCAST_ROWS:
        raise ValueError(f"a registry has {BROADCAST_ROWS} keys at most")
    aliases = registry.select("key", "ord", F.explode("aliases").alias("alias")).select("key", "ord", match_key(F.col("alias")).alias("alias")).where("alias <> ''").distinct()
    listed = fields.select("field", F.posexplode("labels").alias("place", "via")).withColumn("norm", match_key(F.col("via"))).where("norm <> ''")
    exact = F.col("alias") == F.col("norm")
    met = listed.select("norm").distinct().join(F.broadcast(aliases), exact | (F.col("norm").contains(F.col("alias")) & (F.length("alias") >= 2)))
    named = met.groupBy("norm").agg(F.min_by("key", F.struct(~exact, F.when(exact, 0).otherwise(-F.length("alias")), "ord")).alias("key"))
    label = listed.join(named, "norm").groupBy("field").agg(F.min_by(F.struct("key", "via"), "place").alias("l"))
    tokens = fields.select("field", F.posexplode(F.split(F.trim("autocomplete"), r"\s+")).alias("place", "token"))
    by_token = registry.where("autocomplete is not null").groupBy("autocomplete").agg(F.min_by("key", "ord").alias("auto")).withColumnRenamed("autocomplete", "token")
    auto = tokens.join(F.broadcast(by_token), "token").groupBy("field").agg(F.max_by("auto", "place").alias("auto"))
    both = fields.select("field", "autocomplete", "masked").join(label, "field", "left").join(auto, "field", "left")
    key, layer = F.coalesce("l.key", "auto"), F.when(F.col("l").isNotNull(), 2).when(F.col("auto").isNotNull(), 1).otherwise(0)
    conflict = F.when(F.col("l").isNotNull() & (F.col("auto") != F.col("l.key")), F.col("auto"))
    told = both.select("field", key.alias("key"), layer.alias("layer"), F.when(F.col("l").isNotNull(), F.col("l.via")).when(F.col("auto").isNotNull(), F.col("autocomplete")).alias("via"), conflict.alias("conflict"), F.coalesce("masked", F.lit(False)).alias("masked"))
    told = told.join(F.broadcast(registry.select("key", F.col("sensitivity").isin("sensitive", "secret").alias("sensitive"))), "key", "left")

    # what else the label of a sensitive key is like, once its longest alias has been cut out
    asked = told.where("sensitive and layer = 2").select("key", "via").distinct().withColumn("norm", match_key(F.regexp_replace("via", r"[（(【\[].*?[)）】\]]", " ")))
    own = asked.join(F.broadcast(aliases.select(F.col("key").alias("of"), "alias")), (F.col("of") == F.col("key")) & F.col("norm").contains(F.col("alias")) & (F.length("alias") >= 2))
    cut = own.groupBy("key", "via", "norm").agg(F.max_by("alias", F.struct(F.length("alias"), "alias")).alias("win")).withColumn("rest", F.replace("norm", "win", F.lit("\x00")))
    other = cut.join(F.broadcast(aliases.select(F.col("key").alias("other"), "alias")), (F.col("other") != F.col("key")) & F.col("rest").contains(F.col("alias")) & (F.length("alias") >= 2))
    like = other.groupBy("key", "via").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("like"))  # no more than the registry has keys
    told = told.join(like, ["key", "via"], "left")
    sensitive = F.coalesce("sensitive", F.lit(False))
    why = F.when(sensitive & F.col("masked"), "hidden words").when(sensitive & F.col("like").isNotNull(), F.concat(F.lit("also like "), F.col("like"))).when(sensitive & F.col("conflict").isNotNull(), F.concat(F.lit("autocomplete says "), F.col("conflict")))
    click = ~sensitive & F.col("conflict").isNotNull()
    return told.withColumn("dropped", why).select("field", F.when(F.col("dropped").isNull(), F.col("key")).alias("key"), "layer", "via", "conflict", click.alias("needs_click"), "dropped")


def free_targets(moves: DataFrame, taken: DataFrame, most: int = 10_000) -> DataFrame:
    """``(id, path, target)``: where each of ``moves(id, path)`` can go back to; null if all names are taken.

    The names of a path are itself, with ``.restored``, then with ``.restored.2`` up to ``most``; moves to
    the same path get the free ones in order of id. ``taken(path)`` holds what is there. Names that are
    taken and moves are laid on one line by how many free names lie before them, so a running count
    tells the name, and neither a list of names nor pairs of both are made.
    """
    wanted = moves.select("id", "path").withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("id")) - 1)
    suffix = F.regexp_extract("path", r"(?s)^(.*)\.restored(?:\.([1-9][0-9]{0,8}))?$", 2)
    base = F.regexp_extract("path", r"(?s)^(.*)\.restored(?:\.([1-9][0-9]{0,8}))?$", 1)
    number = F.when(suffix == "", 1).otherwise(suffix.cast("int"))
    held = taken.select("path").distinct()
    names = held.select("path", F.lit(0).alias("n")).unionByName(held.where((base != "") & (suffix != "1")).select(base.alias("path"), number.alias("n")))
    names = names.join(wanted.select("path").distinct(), "path", "left_semi")
    gaps = names.select("path", (F.col("n") - F.row_number().over(Window.partitionBy("path").orderBy("n")) + 1).alias("at"))
    line = wanted.select("path", "id", F.col("k").alias("at"), F.lit(0).alias("held")).unionByName(gaps.select("path", F.lit(None).cast(moves.schema["id"].dataType).alias("id"), "at", F.lit(1).alias("held")))
    before = F.sum("held").over(Window.partitionBy("path").orderBy("at", F.desc("held")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = line.withColumn("n", F.col("at") + before).where("held = 0")
    target = F.when(F.col("n") == 0, F.col("path")).when(F.col("n") == 1, F.concat("path", F.lit(".restored"))).when(F.col("n") <= most, F.concat("path", F.lit(".restored."), F.col("n").cast("string")))
    return placed.select("id", "path", target.alias("target"))


def stale_proposals(plans: DataFrame, journal: DataFrame, cutoff: Column, skip: str | None = None) -> DataFrame:
    """``plans(plan, status, created_at)`` that are still proposed, were made before ``cutoff`` and never began.

    A plan has begun when ``journal(plan)`` names it; ``skip`` is a plan that stays whatever its age. A null
    creation time is not known to be old.
    """
    old = plans.where((F.col("status") == "proposed") & (F.col("created_at") < cutoff))
    old = old.where(F.col("plan") != skip) if skip is not None else old
    return old.join(journal.select("plan").distinct(), "plan", "left_anti")
