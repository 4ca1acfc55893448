"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. By the pigeonhole principle two fingerprints that differ in
few bits differ in at most a small number of bits of one segment, so each distinct fingerprint
looks up the small Hamming ball around each of its segments and every hit is verified over all
64 bits. How many segments there are follows from the number of fingerprints.

Copies collapse into one fingerprint first. Small buckets are joined; a bucket with many
fingerprints is dealt out as pairs of blocks, and each block pair returns a spanning forest of
its links, so neither the rows nor a task grow with the square of a group.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.llm import near_copies
from filewright.llm._shared import components, small_batches, stash

MAX_BITS = 3
SHINGLE_WORDS = 3
#: Bits within which the stage on near copies looks for candidates: what lies further apart is
#: found by near_copies, and two unrelated texts are hardly ever this close.
NEAR_BITS = 7
#: Buckets of more fingerprints than this are dealt out as block pairs.
BUCKET_ROWS = 32
#: Fingerprints that one side of a block pair holds on average.
BLOCK_ROWS = 1024
#: Shingles hashed before their bits are summed, which bounds memory for very long texts.
CHUNK = 1 << 16

Segment = tuple[int, int, int]


def segments(n: int, bits: int) -> list[Segment]:
    """``(first bit, width, radius of the ball)`` of the tables that find ``n`` fingerprints within ``bits``.

    Radii that add up to ``bits + 1`` with one more for each table miss no pair. The number of tables
    is that with the least lookups and chance hits.

    >>> segments(250_000, 3)
    [(42, 22, 1), (21, 21, 0), (0, 21, 0)]
    >>> [len(segments(n, 3)) for n in (10**6, 10**9)], [r for _, _, r in segments(10**9, 3)]
    ([3, 2], [1, 1])
    """

    def cut(tables: int) -> list[Segment]:
        edges = [64 * k // tables for k in range(tables + 1)]
        need = bits + 1 - tables  # the first tables have the larger balls
        radii = [need // tables + (k < need % tables) for k in range(tables)]
        return [(low, high - low, r) for low, high, r in zip(edges[::-1][1:], edges[::-1], radii, strict=False)]

    def cost(tables: int) -> float:
        return sum((1 + sum(comb(w, k) for k in range(1, r + 1)) / 2) * (1 + n / 2**w) for _, w, r in cut(tables))

    return min((cut(t) for t in range(2, max(2, bits) + 1)), key=lambda x: cost(len(x)))


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """The signed 64-bit SimHash of one whole text.

    >>> fingerprint(b"") == fingerprint(None) == 0
    True
    """
    tokens = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    digest = xxhash.xxh64_digest
    if len(tokens) <= words:
        return int.from_bytes(digest(b" ".join(tokens), 42), "big", signed=True)
    total, n = np.zeros(64, np.int64), len(tokens) - words + 1
    for at in range(0, n, CHUNK):
        part = tokens[at : min(at + CHUNK, n) + words - 1]
        hashes = b"".join([digest(b" ".join(x), 42) for x in zip(*(part[i:] for i in range(words)), strict=False)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``(uid, doc_id, fp)`` of every row; a null or blank text has 0."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, words) for x in texts], dtype="int64")

    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", hashed(F.col("text").cast("binary")).alias("fp"))


def _lookup(segment: int, value, stored: bool):
    return F.struct(F.lit(segment).alias("segment"), value.alias("value"), F.lit(stored).alias("stored"))


def _ball(segment: int, value, masks):
    unset = F.filter(masks, lambda m: value.bitwiseAND(m).bitwiseAND(-m) == 0)
    return F.transform(unset, lambda m: _lookup(segment, value.bitwiseXOR(m), False))


def _lookups(nodes: DataFrame, cut: list[Segment]) -> DataFrame:
    """``(segment, value, fp, node, stored)``: the rows of the tables and the balls that read them.

    Of two values that differ only one has to look up the other: that in which the lowest bit that
    differs is unset.
    """
    rows = []
    for n, (first, width, radius) in enumerate(cut):
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        rows.append(F.array(_lookup(n, value, True)))
        if radius:
            masks = [sum(1 << b for b in some) for k in range(1, radius + 1) for some in combinations(range(width), k)]
            rows.append(_ball(n, value, F.lit(masks).cast("array<long>")))
    return nodes.select("fp", "node", F.explode(F.concat(*rows)).alias("x")).select("x.*", "fp", "node")


def _forest(rows: pd.DataFrame, bits: int) -> pd.DataFrame:
    """A spanning forest, of links alone, of the links between the two sides of one block pair."""
    left, right = rows[rows.probe], rows[~rows.probe]
    a, b = left.fp.to_numpy(np.int64).view(np.uint64), right.fp.to_numpy(np.int64).view(np.uint64)
    nodes, index = np.unique(np.concatenate([left.node, right.node]).astype(np.int64), return_inverse=True)
    ia, ib = index[: len(a)], index[len(a) :]
    root, u, v, differing = np.arange(len(nodes)), [], [], []
    for at in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= bits)
        x, y, d = ia[i + at], ib[j], np.bitwise_count(a[i + at] ^ b[j])
        while True:  # hook every root on the least root that a link of its tree leads to, then shorten the paths
            rx, ry = root[x], root[y]
            apart = rx != ry
            if not apart.any():
                break
            x, y, d, high, low = x[apart], y[apart], d[apart], np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart]
            first = np.lexsort((low, high))
            first = first[np.r_[True, np.diff(high[first]) != 0]]
            root[high[first]] = low[first]
            u.append(nodes[x[first]])
            v.append(nodes[y[first]])
            differing.append(d[first])
            while (root != root[root]).any():
                root = root[root]
    none = np.empty(0, np.int64)
    return pd.DataFrame({"u": np.concatenate([none, *u]), "v": np.concatenate([none, *v]), "bits": np.concatenate([none, *differing]).astype(np.int32)})


def links(nodes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(u, v, bits)``, each of at most ``bits`` bits, that connect all ``nodes(fp, node)`` that close."""
    found = stash(_lookups(nodes, segments(nodes.count(), bits)), "simhash-lookups")
    sizes = found.groupBy("segment", "value").agg(F.count_if("stored").alias("held"), F.count("*").alias("all")).where("held > 0 and all > 1")
    sized = found.join(sizes, ["segment", "value"])

    few = sized.where(F.col("held") <= BUCKET_ROWS)
    key = ["segment", "value"]
    pairs = (
        few.select(*key, F.col("fp").alias("fa"), F.col("node").alias("u"), F.col("stored").alias("own"))
        .join(few.where("stored").select(*key, F.col("fp").alias("fb"), F.col("node").alias("v")), key)
        .withColumn("bits", F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))).cast("int"))
        .where((F.col("bits") <= bits) & (~F.col("own") | (F.col("u") < F.col("v"))) & (F.col("u") != F.col("v")))
        .select("u", "v", "bits")
    )

    blocks = F.ceil(F.col("all") / BLOCK_ROWS)
    many = sized.where(F.col("held") > BUCKET_ROWS).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    probing = many.select(*key, F.col("block").alias("i"), F.explode(others).alias("j"), "fp", "node", F.lit(True).alias("probe"))
    stored = many.where("stored").select(*key, F.explode(others).alias("i"), F.col("block").alias("j"), "fp", "node", F.lit(False).alias("probe"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _forest(rows, bits)

    return pairs.unionByName(probing.unionByName(stored).groupBy(*key, "i", "j").applyInPandas(run, "u long, v long, bits int"))


def dedup(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """``(uid, doc_id, fp, fingerprint, component_id)`` of every row of ``docs(doc_id, text, ...)``.

    component_id is the smallest doc_id reachable over links of at most ``bits`` bits. Null and
    blank texts share fingerprint zero; repeated rows are kept; an empty table gives no rows;
    other columns are ignored. A row without a doc_id links like any other and never names a
    component, unless its component has no doc_id at all.
    """
    own = stash(fingerprints(docs, words), "simhash-fp")
    nodes = stash(own.groupBy("fp").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least")), "simhash-nodes")
    joined = nodes.join(components(links(nodes.select("fp", "node"), bits), "simhash"), "node", "left").select("fp", "least", F.coalesce("component", "node").alias("component"))
    named = joined.select("fp", "component").join(joined.groupBy("component").agg(F.min("least").alias("component_id")), "component").drop("component")
    return own.join(named, "fp").select("uid", "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = NEAR_BITS) -> DataFrame:
    """One row of ``docs(doc_id, text, ...)`` for each component: its smallest doc_id, nulls last.

    Two texts are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or
    more. Multi-index hashing over five-word fingerprints finds the pairs within ``bits`` bits;
    :func:`near_copies.links` verifies them on the whole sets, the closest of each text first and
    the others while their texts are apart, and adds similar pairs further apart. Texts with the same shingles are one, as are null and blank ones. Of
    equal or missing doc_ids the first row is kept. Columns of any name are returned as they are.
    """
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("__row")
    rows = near_copies.shingled(docs.select(others, "doc_id", "text"), ["doc_id", "__row"])
    own = rows.drop("__row")
    nodes = stash(own.groupBy("digest").agg(F.min("uid").alias("node"), F.first("fp").alias("fp")), "near-nodes")
    found = components(near_copies.links(own, nodes, stash(links(nodes.select("fp", "node"), bits), "near-simhash")), "near")
    named = nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    chosen = own.select("uid", "doc_id", "digest").join(named, "digest").groupBy("component").agg(F.min_by("uid", F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("uid"))
    return rows.join(chosen, "uid", "left_semi").select(*("text" if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns))
