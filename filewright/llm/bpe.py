"""Byte-level BPE encoding and decoding of whole texts.

A piece of text starts as a doubly linked list of byte symbols. A heap holds the rank and place
of every adjacent pair that can merge; the lowest rank, leftmost first, is taken, entries whose
symbols have changed since are skipped, and the new neighbours enter the heap. Decoding joins
vocabulary strings. The vocabulary file is a parameter and is read by each Python worker.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.llm._shared import small_batches

# Unicode white space, and the pattern that byte-level vocabularies split text by.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
SPLIT = r""" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""".replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
#: Runs without white space, with the blank before them, and runs of white space: no match of
#: SPLIT reaches across them.
RUNS = f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: More than any id.
PAIR = 1 << 20
#: Encoded runs and pieces that a worker remembers. Longer ones are encoded anew each time.
MEMO_RUNS, MEMO_PIECES, MEMO_CHARS = 1_200_000, 600_000, 64


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


class Codec(dict):
    """Maps a run of text to its packed ids; a missing run is encoded and remembered."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        split, model = read.get("pre_tokenizer") or {}, read["model"]
        plain = read.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if not plain or model.get("ignore_merges") or model.get("end_of_word_suffix") or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in read["added_tokens"]):
            raise ValueError(f"{path} is no byte-level vocabulary with the usual split and no normaliser")
        of = _byte_chars()
        vocab = read["model"]["vocab"]
        special = {x["content"]: x["id"] for x in read["added_tokens"]}
        self.text = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            self.text[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        for token, i in special.items():
            self.text[i] = token.encode()
        self.special = special
        self.byte_id = [vocab.get(c, -1) for c, _ in sorted(of.items(), key=lambda x: x[1])]
        self.merge: dict[int, tuple[int, int]] = {}  # a pair of ids as one number: rank, new id
        for rank, pair in enumerate(read["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault(vocab[a] * PAIR + vocab[b], (rank, vocab[a + b]))
        self.runs = re.compile(RUNS)
        self.split = regex.compile(SPLIT)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces: dict[str, bytes] = {}

    def merged(self, piece: str) -> list[int]:
        """The ids of one piece."""
        ids = [i for i in map(self.byte_id.__getitem__, piece.encode("utf-8", "replace")) if i >= 0]
        n, known = len(ids), self.merge.get
        heap = [(found[0], i) for i in range(n - 1) if (found := known(ids[i] * PAIR + ids[i + 1]))]
        if not heap:
            return ids
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = heappop(heap)
            j, left = after[i], ids[i]
            if left < 0 or j >= n:
                continue  # stale: i was merged into its left neighbour, or became the last
            found = known(left * PAIR + ids[j])
            if not found or found[0] != rank:
                continue  # stale: one of the two has changed
            left = ids[i] = found[1]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := known(left * PAIR + ids[k]):
                    heappush(heap, (found[0], i))
            h = before[i]
            if h >= 0 and (found := known(ids[h] * PAIR + left)):
                heappush(heap, (found[0], h))
        return [i for i in ids if i >= 0]

    def packed(self, piece: str) -> bytes:
        """The packed ids of one piece, remembered."""
        found = self.pieces.get(piece)
        if found is None:
            found = array("i", self.merged(piece)).tobytes()
            if len(piece) <= MEMO_CHARS:
                if len(self.pieces) >= MEMO_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def __missing__(self, run: str) -> bytes:
        packed = b"".join(map(self.packed, self.split.findall(run)))
        if len(run) <= MEMO_CHARS:
            if len(self) >= MEMO_RUNS:
                self.clear()
            self[run] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, packed as native 32-bit integers."""
        if not self.at_special or not any(x in text for x in self.special):
            return b"".join(map(self.__getitem__, self.runs.findall(text)))
        out = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
            else:
                out += map(self.__getitem__, self.runs.findall(part))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.text.__getitem__, memoryview(packed).cast("i"))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(packed: list[bytes]) -> pa.Array:
    ends, at = [0], 0
    for x in packed:
        at += len(x) // 4
        ends.append(at)
    values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every whole text; null counts as empty, and has no ids."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([own.encode(x) for x in _texts(batch.column(1))])], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of ``encoded(doc_id, ids)``; null ids give an empty text."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(array("i", x or []).tobytes()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: :func:`encode` and :func:`decode` of every row in one pass.

    A null text is encoded as an empty one. Repeated rows, ties and null ids stay as rows; other
    columns are ignored; an empty table gives no rows. Memory follows the largest batch of texts.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            packed = [own.encode(x) for x in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(packed), pa.array(map(own.decode, packed), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
