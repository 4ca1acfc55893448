import math
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from filewright.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_match_the_library():
    own, rng = packing.words(PATH), random.Random(2)
    latin = "ªµßàÀ×² \x85\xa0\x1c\x1fab AB's ,.!012"
    texts = ["".join(rng.choice(latin) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", "Σ", "é"]) for _ in range(3000)]
    got = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_evolution_keeps_every_piece_and_improves_on_its_elites():
    rng = np.random.default_rng(0)
    for n in (1, 7, 300):
        sizes = np.sort(rng.integers(1, 4096, n))[::-1].copy()
        alone = [[i] for i in range(n)]
        bins = packing.evolve(sizes, 4096, 1, [alone])
        assert sorted(i for b in bins for i in b) == list(range(n))
        assert all(sizes[b].sum() <= 4096 for b in bins) and len(bins) <= n


def test_crossover_injects_full_bins_and_repairs():
    lengths = [60, 40, 70, 30, 50, 50]
    child = packing._cross([[0], [1], [2], [3], [4], [5]], [[0, 1], [2, 3], [4, 5]], lengths, 100, np.random.default_rng(4))
    assert sorted(i for b in child for i in b) == list(range(6))
    assert all(sum(lengths[i] for i in b) <= 100 for b in child) and len(child) < 6


def test_packing_is_whole_valid_and_near_the_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 200)
    rng = random.Random(3)
    rows = [(n, n % 7, 0, 0, rng.choice([4096, rng.randint(1, 4095), rng.randint(1, 400)])) for n in range(1500)]
    cut = spark.createDataFrame(rows, "row long, doc_id long, piece int, start long, length long")
    got = packing.pack(cut).toPandas()
    assert sorted(got.length) == sorted(r[4] for r in rows)
    for _, bin_ in got.groupby("sequence_id"):
        at = 0
        for r in bin_.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 4096) + 3


def test_pieces_that_never_fit_together_settle(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 20)
    cut = spark.createDataFrame([(n, n, 0, 0, 2100 + n, 7) for n in range(100)], "row long, doc_id long, piece int, start long, length long, sequence_id int")
    got = packing.pack(cut).toPandas()
    assert got.sequence_id.nunique() == len(got) == 100 and (got.offset == 0).all()


def test_other_vocabularies_are_encoded_by_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello World's end", "x  y", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Words(path).encode(texts)] == [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_query_over_odd_rows(spark, tmp_path):
    rows = [(1, "Hello world", 1), (2, None, 1), (3, "", 1), (3, "", 1), (4, "word " * 9000, 1), (None, "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, length int").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_packing(spark, str(tmp_path)).collect()
    library, expected = Tokenizer.from_file(PATH), []
    for i, text, _ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(i or 0, at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for at in range(0, len(ids), 4096)]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    empty = spark.createDataFrame([], "row long, doc_id long, piece int, start long, length long")
    assert packing.pack(empty).count() == 0
