"""Byte-level encoding by the tokenizers library, with each piece of a text encoded once a worker."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: Encoded pieces that a worker remembers, none longer than MEMO_CHARS: some 200 bytes each, so
#: about 240 MB at most. Longer ones are encoded anew each time.
MEMO_PIECES, MEMO_CHARS = 1_200_000, 64
# The letters, digits and white space of Latin-1 in the pattern by which byte-level
# vocabularies split text, and the character that stands for a line feed in their files.
_LETTERS, _DIGITS, _BLANKS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r\x20\x85\xa0"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_BLANKS}{_LETTERS}{_DIGITS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")
FEED = "Ċ"


class Pieces:
    """Packed ids (little-endian 32-bit) of whole texts, as the library gives them for a byte-level file.

    Latin-1 texts are cut into the pieces that the file's split makes, which no token crosses; other
    texts, and all with a file that has another split, are encoded by the library as they are. With
    ``plain`` the strings of special tokens are ordinary text; otherwise texts that hold one are
    encoded whole as well. ``memo`` bounds the pieces that are remembered.
    """

    def __init__(self, path: str, plain: bool = False, memo: int = MEMO_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        read = json.loads(self.tokenizer.to_str())
        split = read.get("pre_tokenizer") or {}
        self.known = read.get("normalizer") is None and split.get("type") == "ByteLevel" and bool(split.get("use_regex")) and not split.get("add_prefix_space")
        # the same model for pieces in the file's own spelling, set apart by a token that stands in none
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Split(FEED, "isolated")
        self.feed = self.tokenizer.token_to_id(FEED)
        self.known = self.known and self.feed is not None
        self.memo: dict[str, bytes] = {}
        self.most = memo

    def by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, unknown: list[str]) -> list[bytes]:
        """The ids of pieces; those of printable ASCII are spelled as they are, but for the blank."""
        plain = [x.isascii() and x.isprintable() for x in unknown]
        joined = FEED.join([x for x, p in zip(unknown, plain, strict=True) if p]).replace(" ", "Ġ")
        ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids if joined else [], "<u4")
        packed, ends = ids.tobytes(), [*(4 * np.flatnonzero(ids == self.feed)).tolist(), 4 * len(ids)]
        starts = iter([0, *(x + 4 for x in ends)])
        pieces = (packed[a:b] for a, b in zip(starts, ends, strict=False))
        others = iter(self.by_library([x for x, p in zip(unknown, plain, strict=True) if not p]))
        return [next(pieces) if p else next(others) for p in plain]

    def encode(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        for text in texts:
            try:
                text.encode("latin-1")
                split.append(None if not self.known or any(x in text for x in self.special) else LATIN.findall(text))
            except UnicodeEncodeError:
                split.append(None)
        local, unknown, known = dict.fromkeys(chain.from_iterable(filter(None, split))), [], self.memo.get
        for piece in local:  # each piece of a batch is looked up once
            found = known(piece)
            if found is None:
                unknown.append(piece)
            else:
                local[piece] = found
        for at in range(0, len(unknown), 10_000):
            some = unknown[at : at + 10_000]
            if len(self.memo) + len(some) > self.most:
                self.memo.clear()
            for piece, packed in zip(some, self.learn(some), strict=True):
                local[piece] = packed
                if len(piece) <= MEMO_CHARS:
                    self.memo[piece] = packed
        return [self.by_library([text])[0] if x is None else b"".join(map(local.__getitem__, x)) for text, x in zip(texts, split, strict=True)]


@lru_cache(maxsize=2)
def pieces(path: str, plain: bool = False, memo: int = MEMO_PIECES) -> Pieces:
    return Pieces(path, plain, memo)
