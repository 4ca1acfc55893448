import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from filewright.llm import differencing, pieces, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def naive(sizes, windows):
    """Differencing on dense tuples, as it is defined."""
    partial = [[(s, [i])] + [(0, [])] * (windows - 1) for i, s in enumerate(sizes)]
    while len(partial) > 1:
        partial.sort(key=lambda p: p[-1][0] - p[0][0])
        one, two = partial[:2]
        merged = sorted(((a + b, x + y) for (a, x), (b, y) in zip(one, two[::-1], strict=True)), key=lambda w: -w[0])
        partial = [*partial[2:], merged]
    return sorted(w[0] for w in partial[0])


def test_differencing_is_as_defined_and_close_to_the_optimum():
    rng = random.Random(1)
    for _ in range(200):
        sizes, windows = [rng.randint(1, 99) for _ in range(rng.randint(1, 7))], rng.randint(1, 4)
        made = differencing.difference(sizes, windows)
        assert len(made) == windows and sorted(i for w in made for i in w) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in w) for w in made]
        best = min(max(sum(s for s, w in zip(sizes, to, strict=True) if w == k) for k in range(windows)) for to in product(range(windows), repeat=len(sizes)))
        assert best <= max(sums) <= best * 4 / 3 + 1
    sizes = [rng.choice([rng.randint(1, 900), 300]) for _ in range(400)]
    for windows in (7, 60, 300):
        sums = sorted(sum(sizes[i] for i in w) for w in differencing.difference(sizes, windows))
        dense = naive(sizes, windows)
        assert sum(sums) == sum(sizes) and sums[-1] - sums[0] <= max(dense[-1] - dense[0], 3) + 1


def test_window_count_rises_until_all_fit():
    sizes = np.array([600] * 9 + [500])
    assert differencing.windows_of(sizes, 1024, 7) is None
    made = differencing.windows_of(sizes, 1024, None)
    assert len(made) == 10 and all(sizes[w].sum() <= 1024 for w in made)
    assert len(differencing.windows_of(np.array([512] * 10), 1024, 5)) == 5


LIBRARY = Tokenizer.from_file(PATH)


def encoded(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, got, capacity=1024):
    """Every id lies in exactly one piece and windows are gapless; the padding of those that are not full."""
    want = {i: encoded(t) for i, t in rows}
    for doc, pieces in got.groupby("doc_id"):
        ids, at = want[doc], 0
        for r in pieces.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert set(got.doc_id) == set(want)
    padding = 0
    for _, window in got.groupby("sequence_id"):
        at = 0
        for r in window.sort_values("offset").itertuples():
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(1, got.length.sum())


@pytest.mark.parametrize("shard", [4096, 40])
def test_pieces_cover_every_id_once(spark, shard):
    rng = random.Random(7)
    odd = [None, "", "x", "word " * 1023, "word " * 1024, "word " * 5000, "<|endoftext|>a<|endoftext|>", "naïve 東京 🙂\x00", "\n\n  \t x"]
    rows = [*enumerate(odd), *((n, " ".join(rng.choice(["alpha", "beta", "γ", "12,"]) for _ in range(rng.randint(1, 900)))) for n in range(20, 320))]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(4)
    got = differencing.pack(frame, PATH, shard_pieces=shard).toPandas()
    assert check(rows, got) < (0.02 if shard == 4096 else 0.12)


def test_long_pieces_are_cut_where_windows_would_stay_half_empty(spark):
    rows = [(n, "word " * 620) for n in range(60)]
    got = differencing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).toPandas()
    assert check(rows, got) < 0.05 and got.length.max() <= 620


def test_empty_missing_and_repeated_rows(spark):
    frame = spark.createDataFrame([(None, None), (5, "a b"), (5, "a b")], "doc_id long, text string")
    got = differencing.pack(frame, PATH).toPandas()
    assert sorted(got.length) == [1, 3, 3] and sorted(got.offset) == sorted(np.r_[0, got.sort_values("offset").length.cumsum()[:-1]])
    assert differencing.pack(frame.limit(0), PATH).count() == 0


def test_pieces_match_the_library():
    rng = random.Random(2)
    some = "ab '\n\t\r\x20\x85\xa0　.,1é東🙂\x00 "
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 50))) + rng.choice(["", "", "<|endoftext|>", " don't", "  ", "東　🙂", "Ċ"]) for _ in range(3000)]
    for plain in (False, True):
        library = Tokenizer.from_file(PATH)
        library.encode_special_tokens = plain
        got = [np.frombuffer(x, "<u4").tolist() for x in pieces.pieces(PATH, plain).encode(texts)]
        assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_query_packs_all_documents(spark):
    got = queries.op13_differencing(spark, "/root/testdata/sf0.001").toPandas()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert check(rows, got) < 0.02
