"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A chromosome is a packing. Crossover injects whole well-filled bins of one parent into the
other, drops the bins that now hold a repeated document, and best-fits what was displaced.
Spark deals the pieces into shards of bounded size; every shard is evolved on several islands
in separate tasks, elites migrate to the next island between epochs, and the pieces of poorly
filled bins of all shards meet in new shards, level by level.
"""

from __future__ import annotations

import json
import math
import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filewright.llm._shared import small_batches, stash
from filewright.llm.bpe import _byte_chars

CAPACITY = 4096
END_ID = 1
#: Pieces that a shard holds on average, islands of a shard, and epochs between migrations.
SHARD_PIECES, ISLANDS, EPOCHS = 4096, 3, 2
#: Packings that live on an island, and the generations of an epoch.
POPULATION, GENERATIONS = 4, 6
#: More shards of a level and bins of a shard than there can be; both only make numbers of bins.
SHARDS_MOST, BINS_MOST = 1 << 34, 1 << 24
#: Bins filled less than this are opened again when shards meet.
WELL_FILLED = 0.98
#: Encoded words that a worker remembers. Longer words are encoded anew each time.
MEMO_WORDS, MEMO_CHARS = 1_200_000, 64


# The letters, digits and white space of Latin-1 after lower-casing, in the pattern
# by which vocabularies with word ends split text.
_LETTERS, _DIGITS, _BLANKS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r\\x20\\x85\\xa0"
PLAIN = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
LATIN = re.compile(f"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_DIGITS}]|[^{_BLANKS}{_LETTERS}{_DIGITS}]+")


class Words(dict):
    """Maps a piece of lower-case Latin-1 text to its packed ids; other texts are encoded whole.

    That holds for vocabulary files with the normaliser and split above; with any other file the
    library encodes every text whole.

    The vocabulary marks the last token of every piece, so unknown pieces go through the
    tokenizer together and their ids are told apart by that mark.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # the same model behind a plain split at blanks, for pieces that are normalised and split
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        read = json.loads(self.tokenizer.to_str())
        self.known = read["normalizer"] == PLAIN and read["pre_tokenizer"] == SPLIT and read["model"].get("end_of_word_suffix") == "</w>"
        self.chars = {b: c for c, b in _byte_chars().items()}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, unknown: list[str], local: dict[str, bytes]) -> None:
        """Encode pieces that no document had before, into ``local`` and the worker's memory."""
        if len(self) + len(unknown) > MEMO_WORDS:
            self.clear()
        for at in range(0, len(unknown), 2000):
            some = unknown[at : at + 2000]
            spelled = [p if p.isascii() and p.isprintable() else "".join(map(self.chars.__getitem__, p.encode())) for p in some]
            ids = np.array(self.model.encode_batch_fast([" ".join(spelled)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                local.update((p, self.ids(p).tobytes()) for p in some)
                continue
            packed, last = ids.tobytes(), 0
            for piece, end in zip(some, (4 * ends).tolist(), strict=True):
                local[piece] = packed[last:end]
                last = end
                if len(piece) <= MEMO_CHARS:
                    self[piece] = local[piece]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of whole texts, as the tokenizer gives them."""
        split: list[list[str] | None] = []
        for text in texts:
            try:
                text.encode("latin-1")
                split.append(None if not self.known or any(x in text for x in self.special) else LATIN.findall(text.lower()))
            except UnicodeEncodeError:
                split.append(None)
        # the worker's memory is large and slow to reach, so a batch looks each of its pieces up once
        local, unknown, known = dict.fromkeys(chain.from_iterable(filter(None, split))), [], self.get
        for piece in local:
            found = known(piece)
            if found is None:
                unknown.append(piece)
            else:
                local[piece] = found
        self.learn(unknown, local)
        return [self.ids(text).tobytes() if x is None else b"".join(map(local.__getitem__, x)) for text, x in zip(texts, split, strict=True)]


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``(row, doc_id, piece, start, length, ids)`` of every document, ids packed little-endian.

    A document is its token ids and one end id; only longer ones are cut, into pieces of
    ``capacity`` tokens. A null or empty text is the end id alone. row tells repeated rows apart.
    """
    small_batches(docs.sparkSession)
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    end, step = np.array([END_ID], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words(path)
        for batch in batches:
            row, doc, text = batch.columns
            packed = [x + end for x in own.encode([x or "" for x in text.to_pylist()])]
            cut = [(n, at) for n, x in enumerate(packed) for at in range(0, len(x), step)]
            source = pa.array([n for n, _ in cut], pa.int32())
            ids = [packed[n][at : at + step] for n, at in cut]
            yield pa.RecordBatch.from_arrays(
                [row.take(source), doc.take(source), pa.array([at // step for _, at in cut], pa.int32()), pa.array([at // 4 for _, at in cut], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["row", "doc_id", "piece", "start", "length", "ids"],
            )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return numbered.mapInArrow(run, f"row long, doc_id {doc_id}, piece int, start long, length long, ids binary")


# --- the genetic algorithm of one island; a packing is an array with the bin of each item ---


def _best_fit(items: np.ndarray, lengths: list[int], bins: list[list[int]], free: list[int], capacity: int) -> None:
    """Put every item into the bin with the least room that takes it, or into a new one."""
    room = sorted((f, b) for b, f in enumerate(free))
    for item in items:
        size = lengths[item]
        at = bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([])
            free.append(capacity)
            b = len(bins) - 1
        else:
            b = room.pop(at)[1]
        bins[b].append(item)
        free[b] -= size
        if free[b]:
            insort(room, (free[b], b))


def _fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def _cross(one: list[list[int]], two: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    full = [b for b in two if sum(lengths[i] for i in b) >= WELL_FILLED * capacity] or two
    injected = [list(b) for b in full if rng.random() < 0.5]
    held = {i for b in injected for i in b}
    kept = [list(b) for b in one if held.isdisjoint(b)]
    if kept and len(kept) > 2:  # mutation: the emptiest bin is opened as well
        kept.remove(min(kept, key=lambda b: sum(lengths[i] for i in b)))
    bins = injected + kept
    placed = {i for b in bins for i in b}
    displaced = sorted((i for i in range(len(lengths)) if i not in placed), key=lambda i: -lengths[i])
    _best_fit(displaced, lengths, bins, [capacity - sum(lengths[i] for i in b) for b in bins], capacity)
    return bins


def evolve(sizes: np.ndarray, capacity: int, seed: int, elites: list[list[list[int]]]) -> list[list[int]]:
    """The best packing found; ends at once when no packing can have fewer bins."""
    lengths, rng = sizes.tolist(), np.random.default_rng(seed)
    least = math.ceil(sum(lengths) / capacity)
    alive = [[list(b) for b in e] for e in elites]
    while len(alive) < POPULATION:
        noise = rng.normal(0, 0.02 * capacity * (len(alive) + seed % ISLANDS), len(lengths)) if alive or seed % ISLANDS else 0
        bins: list[list[int]] = []
        _best_fit(np.argsort(-(sizes + noise), kind="stable").tolist(), lengths, bins, [], capacity)
        alive.append(bins)
        if len(bins) <= least:
            return bins
    ranked = sorted(alive, key=lambda b: _fitness(b, lengths, capacity), reverse=True)
    for _ in range(GENERATIONS):
        if len(ranked[0]) <= least:
            break
        i, j = rng.choice(len(ranked), 2, replace=False)
        children = [_cross(ranked[i], ranked[j], lengths, capacity, rng), _cross(ranked[j], ranked[i], lengths, capacity, rng)]
        ranked = sorted([*ranked, *children], key=lambda b: _fitness(b, lengths, capacity), reverse=True)[:POPULATION]
    return ranked[0]


def _island(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Evolve one island of one shard; ``origin`` tells the elites apart that have come to it."""
    ordered = group.sort_values(["origin", "length", "row", "piece"], ascending=[True, False, True, True])
    items = ordered[ordered.origin == ordered.origin.iloc[0]]
    elites = []
    for _, elite in ordered.groupby("origin"):
        if (elite.bin >= 0).all():
            codes = elite.bin.to_numpy()
            order = np.argsort(codes, kind="stable")
            elites.append([b.tolist() for b in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)])
    shard, island = int(items["shard"].iloc[0]), int(items["island"].iloc[0])
    sizes = items["length"].to_numpy(np.int64)
    bins = evolve(sizes, capacity, shard * ISLANDS + island, elites)
    of, fill = np.zeros(len(items), np.int64), np.zeros(len(bins), np.int64)
    for n, b in enumerate(bins):
        of[b], fill[n] = n, sizes[b].sum()
    least = math.ceil(sizes.sum() / capacity)
    return pd.DataFrame(
        {"shard": shard, "island": island, "row": items.row, "piece": items.piece, "length": items["length"], "bin": of, "filled": fill[of], "bins": len(bins), "quality": float(((fill / capacity) ** 2).mean()), "proven": len(bins) <= least}
    )


_STATE = "shard long, island int, row long, piece int, length long, bin long, filled long, bins int, quality double, proven boolean"


def _evolved(items: DataFrame, capacity: int) -> DataFrame:
    """The best packing of every shard of ``items(shard, row, piece, length)``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _island(group, capacity)

    best = ["shard", F.max_by("island", F.struct(-F.col("bins"), "quality", -F.col("island"))).alias("island")]

    def winners(state: DataFrame) -> DataFrame:
        return state.join(state.groupBy(best[0]).agg(best[1]), ["shard", "island"], "left_semi")

    first = items.withColumn("bin", F.lit(-1).cast("long")).withColumn("origin", F.lit(0))
    islands = F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("island")
    state = stash(first.select("*", islands).groupBy("shard", "island").applyInPandas(run, _STATE), "packing-island")
    done = [winners(state.join(state.where("proven").select("shard").distinct(), "shard", "left_semi"))]
    for _ in range(EPOCHS - 1):
        state = state.join(done[-1].select("shard").distinct(), "shard", "left_anti")
        # the elite of an island stays there and also migrates to the next one
        to = F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))).alias("to")
        meeting = state.select("shard", "row", "piece", "length", "bin", F.col("island").alias("origin"), to).withColumnRenamed("to", "island")
        state = stash(meeting.groupBy("shard", "island").applyInPandas(run, _STATE), "packing-island")
        done.append(winners(state))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _dealt(items: DataFrame, n: int, level: int) -> DataFrame:
    shards = max(1, math.ceil(n / SHARD_PIECES))
    return items.withColumn("shard", F.pmod(F.xxhash64("row", "piece", F.lit(level)), F.lit(shards)))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` with sequence_id and offset: pieces packed into few sequences of ``capacity``.

    Full pieces are sequences of their own. Takes ``(row, doc_id, piece, length, ...)`` with every
    length in 1..capacity; a sequence's pieces lie gapless from offset 0. Pieces of poorly filled
    bins are dealt anew until that saves no more bins. An empty table gives no rows; ties are broken
    by row and piece; columns named sequence_id, offset or number are replaced. Ids are level, shard
    and bin in one number, and below zero for full pieces.
    """
    cut = stash(cut.drop("sequence_id", "offset").withColumn("number", F.monotonically_increasing_id()), "packing-pieces")
    open_items = cut.where(F.col("length") < capacity).select("row", "piece", "length")
    loose = F.col("filled") < WELL_FILLED * capacity
    n, level, packed, before, before_bins = open_items.count(), 0, [], None, None
    while n:
        sequence = (F.lit(level).cast("long") * SHARDS_MOST + F.col("shard")) * BINS_MOST + F.col("bin")
        state = stash(_evolved(_dealt(open_items, n, level), capacity).withColumn("sequence_id", sequence), "packing-level")
        bins, loose_bins, left = state.agg(F.count_distinct("sequence_id"), F.count_distinct(F.when(loose, F.col("sequence_id"))), F.count_if(loose)).first()
        if before is not None and bins >= before_bins:
            packed.append(before)
            break
        if n <= SHARD_PIECES or not left:
            packed.append(state)
            break
        packed.append(state.where(~loose))
        before, before_bins = state.where(loose), loose_bins
        open_items, n, level = before.select("row", "piece", "length"), left, level + 1
    full = cut.where(F.col("length") >= capacity).select("row", "piece", "length", (-1 - F.col("number")).alias("sequence_id"))
    for more in packed:
        full = full.unionByName(more.select("row", "piece", "length", "sequence_id"))
    inside = Window.partitionBy("sequence_id").orderBy("row", "piece")
    placed = full.select("row", "piece", "sequence_id", (F.sum("length").over(inside) - F.col("length")).alias("offset"))
    return cut.join(placed, ["row", "piece"]).drop("row", "number")
