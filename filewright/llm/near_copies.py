"""What SimHash leaves of near copies: texts of a given Jaccard similarity, found without a miss.

The similarity of two texts is that of their sets of five-word shingles. SimHash finds most near
copies, but fingerprints of texts that are just similar enough may differ in any number of bits.
Two sets as similar as asked for share one of their first shingles in any order that both follow,
so the texts that SimHash left apart are looked up by a prefix of their shingles. Common shingles
come last in that order. Every link is verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filewright.llm._shared import components, discard, small_batches, stash

WORDS = 5
#: The least similarity of a link as a fraction, so that its bounds are whole numbers.
NUM, DEN = 4, 5
#: Texts that say which shingles are common, and how many of those come last. Both only set the
#: order of lookups: any order finds the same links.
ORDER_TEXTS, COMMON = 5000, 20_000
#: Hashes whose bits are summed at once, which bounds memory for very long texts.
CHUNK = 1 << 16
#: Closest partners of a text that are compared first, and texts of a bucket that then meet its
#: others, before all that are still apart are compared. Neither bounds what is found.
STARS, MORE_STARS = 3, 32
#: Counters of a set that go with its rows while pairs are formed; fewer bound less, and drop nothing.
COUNTERS = 64
#: Rows to compare are broadcast up to this many, one number each; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of a text's word shingles; a shorter text is one shingle, a blank one none.

    >>> len(shingles(b"a b c d e F")), len(shingles(b"a b")), len(shingles(None))
    (2, 1, 0)
    """
    tokens = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    whole = zip(*(tokens[i:] for i in range(words)), strict=False) if len(tokens) >= words else [tokens]
    return np.unique(np.array([digest(b" ".join(x), 42) for x in whole], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The signed SimHash of unsigned 64-bit hashes: a bit is set if over half of them have it."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        rows = np.ascontiguousarray(hashes[at : at + CHUNK], ">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big", signed=True)


def _is_common(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    at = np.searchsorted(common, hashes)
    at[at == len(common)] = 0
    return common[at] == hashes if len(common) else np.zeros(len(hashes), bool)


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set, common ones last, that a similar set must share one of."""
    last = _is_common(hashes, common)
    n = len(hashes)
    return np.concatenate([hashes[~last], hashes[last]])[: n - -(-n * NUM // DEN) + 1 if n else 0]


def _listed(series: pd.Series, of) -> pd.Series:
    return pd.Series([of(shingles(x)).view(np.int64) for x in series], dtype=object)


def spread(hashes: np.ndarray) -> np.ndarray:
    """How many hashes of a set begin with each value of their leading bits, four to twelve to a value.

    What two sets share is at most the sum of the smaller counts, which costs far less to know
    than the sets.
    """
    bits = max(2, (len(hashes) // 6).bit_length())
    return np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def shingled(docs: DataFrame, extra: list[str]) -> DataFrame:
    """``(uid, text, *extra, digest, n, fp, spread)``: a number of the row, and what its shingles give."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("digest string, n long, fp long, spread array<int>")
    def summed(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(x) for x in texts]
        return pd.DataFrame({"digest": [xxhash.xxh3_128_hexdigest(x.tobytes()) for x in sets], "n": [len(x) for x in sets], "fp": np.array([majority(x) for x in sets], np.int64), "spread": [spread(x) for x in sets]})

    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), "text", *extra)
    return stash(numbered.withColumn("__own", summed(F.col("text").cast("binary"))), "near-own").select("uid", "text", *extra, "__own.*")


def _common(own: DataFrame) -> np.ndarray:
    @F.pandas_udf("array<long>")
    def every(x: pd.Series) -> pd.Series:
        return _listed(x, lambda s: s)

    one_in = max(1, own.count() // ORDER_TEXTS)
    some = own.where(F.pmod(F.xxhash64("digest"), F.lit(one_in)) == 0)
    counted = some.select(F.explode(every(F.col("text").cast("binary"))).alias("hash")).groupBy("hash").count().where("count > 3")
    rows = counted.orderBy(F.desc("count"), "hash").limit(COMMON).collect()
    return np.sort(np.array([r["hash"] for r in rows], np.int64).view(np.uint64))


def _as_short(one: str, other: str) -> Column:
    """The counts ``one`` by as few leading bits as ``other`` has."""
    step = F.greatest(F.lit(1), (F.size(one) / F.size(other)).cast("int"))
    summed = lambda i: F.aggregate(F.slice(one, i * step + 1, step), F.lit(0), lambda t, x: t + x)
    return F.when(step == 1, F.col(one)).otherwise(F.transform(F.sequence(F.lit(0), (F.size(one) / step).cast("int") - 1), summed))


def _most(one: str, other: str) -> Column:
    """At most how many shingles two sets share, by their counts."""
    return F.aggregate(F.zip_with(_as_short(one, other), _as_short(other, one), lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)


def _few_counters(counts: str) -> Column:
    """At most COUNTERS counts by fewer leading bits."""
    step = F.greatest(F.lit(1), (F.size(counts) / COUNTERS).cast("int"))
    summed = lambda i: F.aggregate(F.slice(counts, i * step + 1, step), F.lit(0), lambda t, x: t + x)
    return F.when(step == 1, F.col(counts)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(COUNTERS - 1)), summed))


def _similar(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` of rows whose whole sets share NUM / DEN or more of what both hold."""

    @F.pandas_udf("array<long>")
    def every(x: pd.Series) -> pd.Series:
        return _listed(x, lambda s: s)

    used: list[DataFrame] = []

    def rows_of(some: DataFrame, *columns) -> DataFrame:
        wanted = stash(some.select("u").union(some.select("v")).distinct().withColumnRenamed("u", "uid"), "near-wanted")
        used.append(wanted)
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        return own.join(wanted, "uid", "left_semi").select("uid", *columns)

    pairs = stash(pairs, "near-pairs")
    known = rows_of(pairs, "n", "spread")
    one = known.select(F.col("uid").alias("u"), F.col("n").alias("na"), F.col("spread").alias("a"))
    two = known.select(F.col("uid").alias("v"), F.col("n").alias("nb"), F.col("spread").alias("b"))
    possible = pairs.join(one, "u").join(two, "v").where((NUM + DEN) * _most("a", "b") >= NUM * (F.col("na") + F.col("nb")))
    used.append(pairs)
    pairs = stash(possible.select("u", "v"), "near-pairs")
    sets = stash(rows_of(pairs, every(F.col("text").cast("binary")).alias("hashes")), "near-sets")
    one = sets.select(F.col("uid").alias("u"), F.col("hashes").alias("a"))
    two = sets.select(F.col("uid").alias("v"), F.col("hashes").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    found = stash(pairs.join(one, "u").join(two, "v").where((NUM + DEN) * shared >= NUM * (F.size("a") + F.size("b"))).select("u", "v"), "near-links")
    discard(pairs, sets, *used)
    return found


def _may_be(x: str, y: str) -> str:
    """Whether the sizes allow a link and enough shingles may follow one that both sets hold."""
    sizes = f"{DEN} * least(n{x}, n{y}) >= {NUM} * greatest(n{x}, n{y})"
    return f"{sizes} and {NUM + DEN} * least(n{x} - pos{x}, n{y} - pos{y}) >= {NUM} * (n{x} + n{y})"


def _few(pairs: DataFrame) -> DataFrame:
    """Of ``pairs(u, v, bits)`` the STARS closest of each text, ties in one order for all texts.

    A group of copies gives a number of pairs of the order of its texts, not of their square.
    """
    both = pairs.select("u", "v", "bits").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "bits"))
    nearest = Window.partitionBy("u").orderBy("bits", F.xxhash64("v"), "v")
    return both.where("u <> v").withColumn("__n", F.row_number().over(nearest)).where(F.col("__n") <= STARS).select("u", "v")


def links(own: DataFrame, nodes: DataFrame, first: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` that connect all similar pairs of those rows of ``own`` that are ``nodes``.

    ``first`` holds pairs that SimHash has found, with their differing bits; each text needs the
    closest few, and the lookups find what those leave apart. With them each text is compared with that first text of its buckets that
    it meets most often, then with a few more. Only texts that are still in different components
    after that are all compared, so a large group of near copies costs about as many comparisons as
    it has texts.
    """
    common = own.sparkSession.sparkContext.broadcast(_common(own))

    @F.pandas_udf("array<long>")
    def ahead_of(x: pd.Series) -> pd.Series:
        return _listed(x, lambda s: prefix(s, common.value))

    prefixes = stash(own.where("n > 0").select("uid", "n", ahead_of(F.col("text").cast("binary")).alias("first")), "near-prefixes")
    written = prefixes
    prefixes = prefixes.join(nodes.select(F.col("node").alias("uid")), "uid", "left_semi")
    # buckets are aggregated before they move, and a join can split the partition of a common shingle
    looked = prefixes.select("uid", F.col("n").cast("int").alias("n"), F.posexplode("first").alias("pos", "hash"))
    buckets = looked.groupBy("hash").agg(F.min(F.struct("uid", "n", "pos")).alias("star"), F.count("*").alias("rows")).where("rows > 1")
    shared = looked.join(buckets.select("hash", *(F.col(f"star.{x}").alias(f"{x}_s") for x in ("uid", "n", "pos"))), "hash")
    shared = stash(shared.selectExpr("hash", *(f"{x} as {x}_a" for x in ("uid", "n", "pos")), "uid_s", "n_s", "pos_s"), "near-shared")
    discard(written)

    met = shared.where(f"uid_a <> uid_s and {_may_be('_a', '_s')}").groupBy("uid_a", "uid_s").count()
    stars = met.groupBy(F.col("uid_a").alias("v")).agg(F.max_by("uid_s", F.struct("count", "uid_s")).alias("u")).select("u", "v")
    found = _similar(stars.unionByName(_few(first)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), own)
    named = shared.drop("uid_s", "n_s", "pos_s")

    def forest(found: DataFrame, label: str) -> DataFrame:
        """Links that connect what ``found`` connects, one a text."""
        return stash(components(found, label).select(F.col("component").alias("u"), F.col("node").alias("v")), "near-forest")

    named_by: list[DataFrame] = []

    def apart(trees: DataFrame) -> DataFrame:
        """The rows of buckets whose texts are in several of the trees found so far."""
        of = trees.select(F.col("v").alias("uid_a"), F.col("u").alias("component"))
        told = stash(named.join(of, "uid_a", "left").withColumn("c_a", F.coalesce("component", "uid_a")).drop("component"), "near-named")
        named_by.append(told)
        several = told.groupBy("hash").agg(F.min("c_a").alias("least"), F.max("c_a").alias("most")).where("least < most").select("hash")
        return told.join(several, "hash")

    # one more round: some texts of each bucket, the same ones in all buckets, meet its others, and
    # texts that are still apart meet the rest of what SimHash found for them
    found = forest(found, "near-stars")
    # from here on few counts of each set go with its rows: pairs whose sets cannot share enough are not formed
    counters = own.select(F.col("uid").alias("uid_a"), _few_counters("spread").alias("spread_a"))
    rest = stash(apart(found).join(counters, "uid_a"), "near-apart")
    discard(*named_by)
    order = Window.partitionBy("hash").orderBy(F.xxhash64("uid_a"), "uid_a")
    numbered = rest.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= MORE_STARS)
    chosen = stash(numbered.selectExpr("hash", *(f"{x}_a as {x}_s" for x in ("uid", "n", "pos", "c", "spread"))), "near-chosen")
    meeting = rest.join(chosen, "hash").where(F.expr(f"c_a <> c_s and {_may_be('_a', '_s')}") & ((NUM + DEN) * _most("spread_a", "spread_s") >= NUM * (F.col("n_a") + F.col("n_s")))).select(F.least("uid_a", "uid_s").alias("u"), F.greatest("uid_a", "uid_s").alias("v"))
    tree = {x: found.select(F.col("v").alias(x), F.col("u").alias(f"c_{x}")) for x in ("u", "v")}
    others = first.join(tree["u"], "u", "left").join(tree["v"], "v", "left").where("coalesce(c_u, u) <> coalesce(c_v, v)")
    meeting = meeting.unionByName(others.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct()
    found = forest(found.unionByName(_similar(meeting, own)), "near-more")
    # a chosen text has met all of its bucket
    named = rest.join(chosen.selectExpr("hash", "uid_s as uid_a"), ["hash", "uid_a"], "left_anti").drop("c_a")
    rest = apart(found)

    # the smaller set needs only the shorter prefix of two sets of its size
    small = rest.where(f"{NUM + DEN} * pos_a <= {DEN - NUM} * n_a")
    large = rest.select("hash", *(F.col(f"{x}_a").alias(f"{x}_b") for x in ("uid", "n", "pos", "c", "spread")))
    ahead = "(n_a < n_b or (n_a = n_b and uid_a < uid_b)) and c_a <> c_b"
    pairs = small.join(large, "hash").where(F.expr(f"{ahead} and {_may_be('_a', '_b')}") & ((NUM + DEN) * _most("spread_a", "spread_b") >= NUM * (F.col("n_a") + F.col("n_b")))).select(F.col("uid_a").alias("u"), F.col("uid_b").alias("v")).distinct()
    last = _similar(pairs, own)
    discard(shared, rest, chosen, *named_by)
    return found.unionByName(last)
