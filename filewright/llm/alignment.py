"""Cross-tokenizer alignment by a dangling-suffix transducer, and corpus-wide counts of its links.

Two tokenizers spell the same bytes. The transducer reads both token streams; its state is which
side leads and the leader's bytes that the other has not reached yet, always the end of one token.
A transition depends on that residual and the next token alone, so it is computed once and
remembered. Where the residual is empty both sides end a token, and a group closes.

Every pair of tokens of a group is a link. A pair's count is the number of documents that hold it,
over the whole corpus: chunks of documents add up their pairs before anything moves, each chunk gets
the counts of its own pairs back, and no document's links are ever rows of a shuffle.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filewright.llm._shared import small_batches, stash
from filewright.llm.bpe import SPACE, _byte_chars
from filewright.llm.pieces import pieces

#: More than any id of the second tokenizer; makes a pair of ids one number.
PAIR = 1 << 24
#: Characters of text that a chunk holds, and then at most one batch of documents more.
CHUNK_CHARS = 4 << 20
#: Marks that a byte-level split always cuts from the letter before them.
MARKS = ",.;:!?)"
#: Units that a worker remembers between chunks, none longer than UNIT_CHARS: some 400 bytes each.
MEMO_UNITS, UNIT_CHARS = 400_000, 64
#: Nodes and transitions that a worker remembers, and tokens of a group that is remembered whole.
MEMO_NODES, MEMO_MOVES, MEMO_TOKENS = 1_000_000, 500_000, 32


class Group:
    """The tokens of both sides between two common ends, as text and as links."""

    __slots__ = ("a", "b", "links", "text")

    def __init__(self, a: list[int], b: list[int]):
        self.a, self.b, self.links = a, b, len(a) * len(b)
        self.text = f"{','.join(map(str, a))}|{','.join(map(str, b))}"

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The id pairs as numbers, and how often each stands in the group."""
        if self.links == 1:
            return np.array([self.a[0] * PAIR + self.b[0]]), np.ones(1, np.int64)
        a, n = np.unique(self.a, return_counts=True)
        b, m = np.unique(self.b, return_counts=True)
        return (a[:, None] * PAIR + b[None, :]).reshape(-1), (n[:, None] * m[None, :]).reshape(-1)


class Transducer:
    """Reads two token streams of the same bytes and gives the groups between their common ends.

    >>> t = Transducer([b"ab", b"c", b"a", b"bc"], [b"abc", b"a", b"b"])
    >>> t.align([0, 1, 2], [0, 1]), t.align([2, 3], [1, 2])
    ([([0, 1], [0]), ([2], [1])], None)
    """

    def __init__(self, one: list[bytes], two: list[bytes]):
        self.tokens = (one, two)
        self.forget()

    def forget(self) -> None:
        # a residual as a number: whose turn it is (0 or 1) and the bytes that the other side is ahead
        self.residuals: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.turn, self.ahead = [0], [b""]
        self.moves: list[dict[int, int]] = [{}]
        self.n_moves = 0
        # a group so far is a node: its residual, whose turn it is, and what follows each next token
        self.at, self.node_turn, self.nexts, self.parent, self.read = [0], [0], [{}], [-1], [-1]
        self.known: list[Group] = []

    def refresh(self) -> bool:
        """Forget all when there is too much to remember, and say so; numbers of groups start anew then."""
        full = len(self.at) > MEMO_NODES // 2 or self.n_moves > MEMO_MOVES
        if full:
            self.forget()
        return full

    def move(self, residual: int, token: int) -> int:
        """The residual after the next token of the side whose turn it is; -1 if its bytes do not follow."""
        found = self.moves[residual].get(token)
        if found is None:
            turn, ahead = self.turn[residual], self.ahead[residual]
            new = self.tokens[turn][token]
            if len(new) <= len(ahead):
                after = (turn, ahead[len(new) :]) if ahead.startswith(new) else None
            else:
                after = (1 - turn, new[len(ahead) :]) if new.startswith(ahead) else None
            if after is None:
                return -1
            if not after[1]:
                after = (0, b"")
            found = self.residuals.setdefault(after, len(self.turn))
            if found == len(self.turn):
                self.turn.append(after[0])
                self.ahead.append(after[1])
                self.moves.append({})
            self.moves[residual][token] = found
            self.n_moves += 1
        return found

    def _tokens_of(self, node: int) -> tuple[list[int], list[int]]:
        sides: tuple[list[int], list[int]] = ([], [])
        while node:
            up = self.parent[node]
            sides[self.turn[self.at[up]]].append(self.read[node])
            node = up
        return sides[0][::-1], sides[1][::-1]

    def numbered(self, a: list[int], b: list[int]) -> tuple[list[int], list[Group]] | None:
        """The groups of two streams in order: numbers of remembered ones, and -1 - place in the list of the others."""
        out, others, node, depth = [], [], 0, 0
        nexts, turns, streams = self.nexts, self.node_turn, (iter(a).__next__, iter(b).__next__)
        left = len(a) + len(b)
        try:
            while left:
                side = turns[node]
                token = streams[side]()
                left -= 1
                after = nexts[node].get(token)
                if after is None:
                    residual = self.move(self.at[node], token)
                    if residual < 0:
                        return None
                    sides = self._tokens_of(node) if not residual or depth >= MEMO_TOKENS or len(self.at) >= MEMO_NODES else None
                    if sides is None:
                        after = len(self.at)
                        self.at.append(residual)
                        turns.append(self.turn[residual])
                        nexts.append({})
                        self.parent.append(node)
                        self.read.append(token)
                        nexts[node][token] = after
                    else:
                        sides[side].append(token)
                        if residual or depth >= MEMO_TOKENS or len(self.known) >= MEMO_NODES:
                            while residual:  # a group that is not remembered goes on by its transitions alone
                                side = self.turn[residual]
                                token = streams[side]()
                                left -= 1
                                sides[side].append(token)
                                residual = self.move(residual, token)
                                if residual < 0:
                                    return None
                            others.append(Group(*sides))
                            out.append(-len(others))
                            node = depth = 0
                            continue
                        self.known.append(Group(*sides))
                        after = nexts[node][token] = -len(self.known)
                if after < 0:
                    out.append(-1 - after)
                    node = depth = 0
                else:
                    node, depth = after, depth + 1
        except StopIteration:
            return None
        return (out, others) if node == 0 else None

    def align(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]] | None:
        """The groups ``(ids of a, ids of b)`` in order, or None where the streams spell different bytes."""
        self.refresh()
        found = self.numbered(a, b)
        if found is None:
            return None
        return [(x.a, x.b) for x in (self.known[g] if g >= 0 else found[1][-1 - g] for g in found[0])]


class Pair:
    """Both tokenizers of a worker and the transducer between them."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.bytes = pieces(byte_path, plain=True, memo=MEMO_UNITS // 2)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        vocab, of = self.bytes.tokenizer.get_vocab(), _byte_chars()
        one = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            one[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        spell = self.pieces
        two = [bytes([int(spell.id_to_piece(i)[3:5], 16)]) if spell.is_byte(i) else spell.id_to_piece(i).replace("▁", " ").encode() for i in range(spell.get_piece_size())]
        self.one, self.two, self.transducer = one, two, Transducer(one, two)

        # the byte-level split cuts before a blank that follows no white space, and between a letter and a
        # mark; so does the piece model if no piece reaches across, and then such parts stand each alone
        pieces_ = [spell.id_to_piece(i) for i in range(spell.get_piece_size()) if not spell.is_control(i)]
        self.local = self.bytes.known and not any(re.search("[^▁]▁", x) for x in pieces_)
        marks = "".join(x for x in MARKS if not any(re.search(f"[A-Za-z]{re.escape(x)}", y) for y in pieces_))
        mark, word, rest = f"[{re.escape(marks)}]" if marks else "(?!)", " [A-Za-z]+", f"[^{SPACE}]+(?:(?! )[{SPACE}]+)?"
        self.cut = re.compile(f"{word}(?= |{mark})|{mark}(?= )| [{SPACE}]*(?:{rest})*|(?:{rest})+")
        self.blank = spell.piece_to_id("▁")
        self.units: dict[str, Unit | None] = {}

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both tokenizers for parts of texts, None where either does not spell them as they are.

        The piece model adds a blank. A part that begins with another character follows a letter:
        it is encoded behind a blank and a letter that no piece joins to it, which are taken off.
        """
        begins = [x.startswith(" ") for x in texts]
        words = [first and x.isascii() and x[1:].isalpha() for x, first in zip(texts, begins, strict=True)]
        whole = iter(self.bytes.learn([x for x, w in zip(texts, words, strict=True) if w]))  # one piece of the split each
        others = iter(self.bytes.encode([x for x, w in zip(texts, words, strict=True) if not w]))
        encoded = self.pieces.encode([x[1:] if first else "a" + x for x, first in zip(texts, begins, strict=True)], num_threads=1)
        out: list[tuple[list[int], list[int]] | None] = []
        one, two = self.one.__getitem__, self.two.__getitem__
        for text, first, word, b in zip(texts, begins, words, encoded, strict=True):
            a, spelled = memoryview(next(whole) if word else next(others)).cast("I").tolist(), text.encode()
            b = (b if len(text) > 1 else [self.blank]) if first else b[1:]
            out.append((a, b) if b"".join(map(one, a)) == spelled and b"".join(map(two, b)) == spelled else None)
        return out

    def split(self, text: str) -> list[str]:
        """A blank and ``text`` in units that both tokenizers spell each on its own; empty for an empty text."""
        if not text:
            return []
        return self.cut.findall(f" {text}") if self.local else [f" {text}"]

    def learn(self, unknown: list[str]) -> None:
        """Align units that are new, all as one stream, since each of them ends a token on both sides."""
        for at in range(0, len(unknown), 10_000):
            some = unknown[at : at + 10_000]
            tokens = self.tokens(some)
            self.units.update((text, None) for text, x in zip(some, tokens, strict=True) if x is None)
            good = [(text, *x) for text, x in zip(some, tokens, strict=True) if x is not None]
            found = self.transducer.numbered(list(chain.from_iterable(a for _, a, _ in good)), list(chain.from_iterable(b for _, _, b in good)))
            if found is None or found[1]:  # some group is not remembered, so the units are aligned each
                for text, a, b in good:
                    self.units[text] = self._units([(text, a, b)], *self.transducer.numbered(a, b))[0]
            else:
                self.units.update(zip([x[0] for x in good], self._units(good, *found), strict=True))

    def _units(self, good: list[tuple], groups: list[int], others: list[Group]) -> list[Unit]:
        known = self.transducer.known
        of = [known[g] if g >= 0 else others[-1 - g] for g in groups]
        read = np.cumsum([len(x.a) for x in of])  # a unit's last group is the one that reads its last token
        ends = (np.searchsorted(read, np.cumsum([len(a) for _, a, _ in good])) + 1).tolist()
        links, texts = [x.links for x in of], [x.text for x in of]
        packed, out, last = np.array(groups, np.int32).tobytes(), [], 0
        for (_, a, b), end in zip(good, ends, strict=True):
            out.append((len(a), len(b), end - last, sum(links[last:end]), ";".join(texts[last:end]), packed[4 * last : 4 * end], others or None))
            last = end
        return out


#: A part of a text: numbers of tokens, groups and links, the groups as text and as packed numbers,
#: and those groups that are not remembered.
Unit = tuple[int, int, int, int, str, bytes, list[Group] | None]


@lru_cache(maxsize=1)
def pair(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values[order], first)


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start + length - 1 of every span, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Chunk:
    """Documents up to a number of bytes, and the distinct groups and pairs that they hold."""

    def __init__(self, own: Pair):
        if len(own.units) > MEMO_UNITS:
            own.units.clear()
        if own.transducer.refresh():
            own.units.clear()
        self.own, self.size = own, 0
        self.doc_ids: list[object] = []
        self.sums: tuple[list, ...] = ([], [], [], [], [])
        self.groups: list[np.ndarray] = []
        self.others: list[Group] = []

    def add(self, doc_ids: list, texts: list[str]) -> None:
        units = [self.own.split(x) for x in texts]
        local = dict.fromkeys(chain.from_iterable(units))
        self.own.learn([x for x in local if x not in self.own.units])
        for unit in local:
            local[unit] = self.own.units[unit]
            if len(unit) > UNIT_CHARS:
                del self.own.units[unit]
        for doc_id, text, names in zip(doc_ids, texts, units, strict=True):
            parts = list(map(local.__getitem__, names))
            told, own = (0, 0, 0, 0, ""), np.empty(0, np.int32)
            if parts and None not in parts:
                n_a, n_b, n_groups, links, spelled, packed, others = zip(*parts, strict=True)
                own = np.frombuffer(b"".join(packed), np.int32) if not any(others) else self._with_others(parts)
                digest = hashlib.sha256(";".join(spelled).encode()).hexdigest()
                told = (sum(n_a), sum(n_b), sum(n_groups), sum(links), digest)
            self.size += len(text)
            self.doc_ids.append(doc_id)
            self.groups.append(own)
            for column, value in zip(self.sums, told, strict=True):
                column.append(value)

    def _with_others(self, parts: list[Unit]) -> np.ndarray:
        """Numbers of groups where those that are not remembered are places in the chunk's list of them."""
        out = []
        for *_, packed, others in parts:
            groups = np.frombuffer(packed, np.int32)
            out.append(np.where(groups < 0, groups - len(self.others), groups))
            self.others += others or []
        return np.concatenate(out)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of the chunk, and place of document, place of pair and number of links of each pair of a document."""
        lengths, known = np.array([len(x) for x in self.groups], np.int64), self.own.transducer.known
        of = np.concatenate([np.empty(0, np.int32), *self.groups]).astype(np.int64)
        of = np.where(of < 0, len(known) - 1 - of, of)  # the others after those that are remembered
        used = np.flatnonzero(np.bincount(of, minlength=1))
        place = np.zeros(int(of.max(initial=0)) + 1, np.int64)
        place[used] = np.arange(len(used))
        # each distinct group of a document once
        keys = np.sort(np.repeat(np.arange(len(lengths)), lengths) * max(1, len(used)) + place[of])
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        times = np.diff(np.r_[first, len(keys)])
        doc, place = np.divmod(keys[first], max(1, len(used)))
        spelled = [(known[g] if g < len(known) else self.others[g - len(known)]).pairs() for g in used.tolist()]
        held = np.array([len(x) for x, _ in spelled], np.int64)
        flat = np.concatenate([np.empty(0, np.int64), *(x for x, _ in spelled)])
        often = np.concatenate([np.empty(0, np.int64), *(n for _, n in spelled)])
        pairs, of_pair = np.unique(flat, return_inverse=True)
        at = _spans((np.cumsum(held) - held)[place], held[place])
        keys, times = _summed(np.repeat(doc, held[place]) * max(1, len(pairs)) + of_pair[at], np.repeat(times, held[place]) * often[at])
        doc, of_pair = np.divmod(keys, max(1, len(pairs)))
        return pairs, doc, of_pair, times

    def rows(self, chunk: int, doc_type: pa.DataType) -> pa.RecordBatch:
        """A row for each document with places and numbers of its pairs, and a last one with the pairs and their documents."""
        pairs, doc, of_pair, times = self.links()
        n = len(self.doc_ids)
        ends = np.r_[0, np.searchsorted(doc, np.arange(n), "right"), len(doc) + len(pairs)].astype(np.int32)
        counts = np.bincount(of_pair, minlength=len(pairs))
        listed = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x), pa.int64())) for x in ((of_pair, pairs), (times, counts))]
        told = [pa.array([*x, None], pa.int64()) for x in self.sums[:4]]
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk] * (n + 1), pa.int64()), pa.array([False] * n + [True]), pa.array([*self.doc_ids, None], doc_type), *told, pa.array([*self.sums[4], None], pa.string()), *listed],
            ["chunk", "table", "doc_id", *COUNTS, "groups_sha256", "pairs", "times"],
        )


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``(doc_id, groups array<struct<a array<int>, b array<int>>>)``: the aligned tokens of every whole text.

    Groups are empty where :func:`report` counts no tokens.
    """
    small_batches(docs.sparkSession)
    told = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(byte_path, piece_path)
        for batch in batches:
            texts = [f" {x or ''}" for x in batch.column(1).to_pylist()]
            found = [(own.transducer.align(*x) if x and len(text) > 1 else None) or [] for text, x in zip(texts, own.tokens(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"a": a, "b": b} for a, b in x] for x in found], told)], ["doc_id", "groups"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, groups array<struct<a:array<int>,b:array<int>>>")


def report(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row of ``docs(doc_id, text)``.

    A document is a blank and its text, encoded by the byte-level file (A) and by the piece model
    (B), which adds the blank itself; special tokens' strings are ordinary text. Null and empty
    texts, and those that either side does not spell byte by byte, have no tokens: zeros, and an
    empty digest. Counts of pairs are over the documents of the whole table, repeated rows
    included; n_best are links whose count is the highest of their A id, ties included. An empty
    table gives no rows; a null doc_id stays; other columns are ignored. A chunk's memory follows
    CHUNK_CHARS or its one longer text, and the distinct ids of its longest group.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, number = pair(byte_path, piece_path), TaskContext.get().partitionId() << 33
        chunk, arrow = Chunk(own), None
        for batch in batches:
            arrow = batch.column(0).type
            for at in range(0, len(batch), 64):
                ids, texts = (batch.column(c).slice(at, 64).to_pylist() for c in (0, 1))
                chunk.add(ids, [x or "" for x in texts])
                if chunk.size >= CHUNK_CHARS:
                    yield chunk.rows(number, arrow)
                    chunk, number = Chunk(own), number + 1
        if chunk.doc_ids:
            yield chunk.rows(number, arrow)

    columns = f"chunk long, table boolean, doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, pairs array<long>, times array<long>"
    chunks = stash(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, columns), "alignment-chunks")

    # chunks have added up their pairs, so a pair is at most one row a chunk, however common it is
    partial = chunks.where("table").select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "x")).select("chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = stash(partial.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", 24)), "alignment-counts")
    best = counts.groupBy("a").agg(F.max("count").alias("best"))  # no more rows than the first vocabulary has ids
    marked = counts.join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))
    told = partial.join(marked, "pair").select("chunk", "place", "count", "is_best")

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right["place"].to_numpy()
        count, is_best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], is_best[place] = right["count"].to_numpy(), right["is_best"].to_numpy(zero_copy_only=False)
        lengths = left["pairs"].combine_chunks().value_lengths().to_numpy() if len(left) else np.empty(0, np.int64)
        at, times = (left[c].combine_chunks().flatten().to_numpy() for c in ("pairs", "times"))
        ends = np.cumsum(lengths)
        sums = [np.r_[0, np.cumsum(times * x[at])] for x in (is_best, count)]
        n_best, count_sum = (pa.array(x[ends] - x[ends - lengths], pa.int64()) for x in sums)
        return pa.table([left[c] for c in ("doc_id", *COUNTS)] + [n_best, count_sum, left["groups_sha256"]], ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])

    documents = chunks.where("not table").select(F.col("chunk").alias("of_chunk"), "doc_id", *COUNTS, "groups_sha256", "pairs", "times")
    return documents.groupBy("of_chunk").cogroup(told.groupBy("chunk")).applyInArrow(counted, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, n_best long, count_sum long, groups_sha256 string")
