"""Packing by Karmarkar-Karp multiway differencing: near-equal windows of bounded length.

A partial partition is a tuple of window sums; at first each piece is one of its own. The two
partial partitions with the largest differences are merged again and again, the largest windows
of one with the smallest of the other, so that their imbalances oppose each other. The result has
windows of nearly equal length. Their number is the least possible one and rises whenever a
window exceeds the capacity.

Spark cuts documents into pieces while it encodes them; pieces as long as a window are windows of
their own. The others are dealt into shards of bounded size by hash, each differenced in one task.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.llm._shared import small_batches, stash
from filewright.llm.pieces import pieces as encoder

CAPACITY, END_ID = 1024, 0
#: Open pieces that a shard holds on average; a shard wastes about one window.
SHARD_PIECES = 4096
#: More windows of a shard than there can be; makes numbers of windows.
WINDOWS_MOST = 1 << 24
#: The window count of a shard rises by one window in RISE at most; beyond that its pieces are cut
#: at every CELLS-th part of a window, and the count may rise freely.
RISE, CELLS = 128, 4


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """The items of each of ``windows`` near-equal windows, by multiway differencing.

    >>> [sorted(x) for x in difference([8, 7, 6, 5, 4], 2)]
    [[1, 3, 4], [0, 2]]
    >>> difference([], 2), difference([5], 3)
    ([[], []], [[0], [], []])
    """
    # a partial partition: its sums that are not zero, falling as negative numbers, and the node of
    # each window; node i < n is item i, later nodes join two earlier ones
    n, joins = len(sizes), []
    order = sorted(range(n), key=lambda i: -sizes[i])
    # the largest piece stays the largest difference until it has been merged with the next ones into
    # a partition without an empty window
    first = order[:windows]
    partial = [([-sizes[i] for i in first], list(first))] if first else []
    partial += [([-sizes[i]], [i]) for i in order[windows:]]

    def spread(sums: list[int]) -> int:
        return sums[0] - (sums[-1] if len(sums) == windows else 0)  # not above zero: heaps give the least

    heap = [(spread(x), i) for i, (x, _) in enumerate(partial)]
    heapify(heap)
    while len(heap) > 1:
        a, b = (partial[heappop(heap)[1]] for _ in range(2))
        (sums, nodes), (less, others) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
        if len(less) == 1:  # a single piece goes to the smallest window
            x, node = less[0], others[0]
            if len(sums) == windows:
                joins.append((nodes.pop(), node))
                x, node = x + sums.pop(), n + len(joins) - 1
            at = bisect_right(sums, x)
            sums.insert(at, x)
            nodes.insert(at, node)
            partial.append((sums, nodes))
            heappush(heap, (spread(sums), len(partial) - 1))
            continue
        over = len(sums) + len(less) - windows  # windows that both fill: the smallest of either, opposed
        if over > 0:
            kept, alone = len(sums) - over, len(less) - over
            met = list(zip(nodes[kept:][::-1], others[alone:], strict=True))
            added = [(x + y, n + len(joins) + i) for i, (x, y) in enumerate(zip(sums[kept:][::-1], less[alone:], strict=True))]
            joins += met
            sums, nodes = sums[:kept], nodes[:kept]
            added += zip(less[:alone], others[:alone], strict=True)
        else:
            added = list(zip(less, others, strict=True))
        merged = sorted([*zip(sums, nodes, strict=True), *added])
        sums, nodes = [x for x, _ in merged], [node for _, node in merged]
        partial.append((sums, nodes))
        heappush(heap, (spread(sums), len(partial) - 1))
    out = []
    for root in partial[-1][1] if partial else []:
        todo, items = [root], []
        while todo:
            node = todo.pop()
            if node < n:
                items.append(node)
            else:
                todo += joins[node - n]
        out.append(items)
    return out + [[] for _ in range(windows - len(out))]


def windows_of(sizes: np.ndarray, capacity: int, most: int | None) -> list[list[int]] | None:
    """Windows of at most ``capacity``: their number starts at the least and rises until all fit, up to ``most``.

    What the fullest window has above the mean says how far it has to rise, by one window in RISE at once.
    """
    total, listed = int(sizes.sum()), sizes.tolist()
    count = max(1, math.ceil(total / capacity))
    while most is None or count <= most:
        made = difference(listed, count)
        above = max(sum(map(listed.__getitem__, w)) for w in made) - total / count
        if total / count + above <= capacity:
            return made
        count += min(max(1, math.ceil(total / max(1, capacity - above)) - count), max(1, count // RISE))
    return None


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``(row, doc_id, doc_tokens, start, length, crc, cells)`` of every document.

    A document is its ids and one end id; null counts as empty and is the end id alone. It is cut at
    every ``capacity`` ids. crc is the CRC-32 of a piece's little-endian ids; cells holds that of each
    CELLS-th part of a window of a shorter piece, where it may be cut further. row tells repeated rows
    apart.
    """
    small_batches(docs.sparkSession)
    end, step, cell = np.array([END_ID], "<u4").tobytes(), 4 * capacity, 4 * max(1, capacity // CELLS)
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            row, doc, text = batch.columns
            out: list[list] = [[], [], [], [], [], []]
            for n, ids in enumerate(own.encode([x or "" for x in text.to_pylist()])):
                packed = ids + end
                for at in range(0, len(packed), step):
                    piece = packed[at : at + step]
                    cells = [zlib.crc32(piece[i : i + cell]) for i in range(0, len(piece), cell)] if len(piece) < step else None
                    for column, value in zip(out, (n, len(packed) // 4, at // 4, len(piece) // 4, zlib.crc32(piece), cells), strict=True):
                        column.append(value)
            at = pa.array(out[0], pa.int32())
            yield pa.RecordBatch.from_arrays([row.take(at), doc.take(at), *(pa.array(x, pa.int64()) for x in out[1:5]), pa.array(out[5], pa.list_(pa.int64()))], ["row", "doc_id", "doc_tokens", "start", "length", "crc", "cells"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return numbered.mapInArrow(run, f"row long, doc_id {doc_id}, doc_tokens long, start long, length long, crc long, cells array<long>")


def _shard(group: pa.Table, capacity: int) -> pa.Table:
    """The pieces of one shard in windows, in order of row and start within a window."""
    group = group.sort_by([("row", "ascending"), ("start", "ascending")])
    start, length, crc, shard = (group[c].to_numpy() for c in ("start", "length", "crc", "shard"))
    least, source = math.ceil(int(length.sum()) / capacity), np.arange(len(group))
    made = windows_of(length, capacity, least + max(1, least // RISE))
    if made is None:
        cell = max(1, capacity // CELLS)
        parts = -(-length // cell)
        source = np.repeat(source, parts)
        inside = cell * (np.arange(len(source)) - np.repeat(np.cumsum(parts) - parts, parts))
        start, length = start[source] + inside, np.minimum(cell, length[source] - inside)
        crc = group["cells"].combine_chunks().flatten().to_numpy()
        made = windows_of(length, capacity, None)
    order = np.concatenate([np.sort(w) for w in made if w]).astype(np.int64)
    held = np.array([len(w) for w in made if w])
    of = np.repeat(np.arange(len(held)), held)
    ends = np.cumsum(length[order])
    offset = ends - length[order]
    offset -= np.repeat(offset[np.cumsum(held) - held], held)
    source = source[order]
    told = [pa.array(x, pa.int64()) for x in (start[order], length[order], crc[order], group["doc_tokens"].to_numpy()[source], shard[0] * WINDOWS_MOST + of, offset)]
    return pa.table([group["doc_id"].take(pa.array(source)), *told], ["doc_id", "start", "length", "crc", "doc_tokens", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``: documents in windows of at most ``capacity``.

    Every id lies in exactly one piece; a window's pieces lie gapless from offset 0. A document no
    longer than a window stays whole unless the shard's pieces cannot fill windows as they are.
    Null and empty texts are the end id alone; repeated rows are packed each; a null doc_id stays; an
    empty table gives no rows; other columns are ignored. Full pieces have a sequence of their own,
    with a number below zero.
    """
    cut = stash(pieces(docs, path, capacity).withColumn("number", F.monotonically_increasing_id()), "differencing-pieces")
    open_pieces = cut.where(F.col("length") < capacity)
    shards = max(1, math.ceil(open_pieces.count() / shard_pieces))
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        return _shard(group, capacity)

    dealt = open_pieces.withColumn("shard", F.pmod(F.xxhash64("row", "start"), F.lit(shards))).drop("number")
    packed = dealt.groupBy("shard").applyInArrow(run, f"doc_id {doc_id}, start long, length long, crc long, doc_tokens long, sequence_id long, offset long")
    full = cut.where(F.col("length") >= capacity).select("doc_id", "start", "length", "crc", "doc_tokens", (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full).withColumnRenamed("crc", "ids_crc32")
