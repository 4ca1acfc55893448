import numpy as np
import pandas as pd
import pytest
import xxhash

from filewright.llm import simhash


def brute_fp(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "Ärger Über ALLES und mehr x", "x " * 5000])
def test_fingerprint_matches_brute_force(text):
    got = simhash.fingerprint(None if text is None else text.encode())
    assert got & (2**64 - 1) == brute_fp(text)


def test_components_match_brute_force_in_sparse_and_dense_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    dense = [0xF0F0_1234_5678_9ABC ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (150, 3))]
    pairs = [int(x) for x in rng.integers(0, 2**63, 40)]
    near = [x ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for x, (a, b, c) in zip(pairs, rng.integers(0, 64, (40, 3)), strict=True)]
    fps = sorted({*dense, *pairs, *near})
    nodes = pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64), "node": np.arange(len(fps))})
    from filewright.llm._shared import components

    found = dict(components(simhash.links(spark.createDataFrame(nodes)), "t").toPandas().itertuples(index=False))
    assert [found.get(i, i) for i in range(len(fps))] == brute_components(fps)


@pytest.mark.parametrize(("bits", "n"), [(3, 1), (3, 10**9), (7, 1), (7, 10**7)])
def test_any_tables_find_the_same_links(spark, monkeypatch, bits, n):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**63, 60)]
    for size in range(9):
        fps += [x ^ sum(1 << int(b) for b in rng.permutation(64)[:size]) for x in fps[:12]]
    cut = simhash.segments(n, bits)
    monkeypatch.setattr(simhash, "segments", lambda *_: cut)
    nodes = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64), "node": np.arange(len(fps))}))
    for most in (32, 0):  # joined buckets, and buckets dealt out as blocks
        monkeypatch.setattr(simhash, "BUCKET_ROWS", most)
        edges = [(r.u, r.v) for r in simhash.links(nodes, bits).collect()]
        assert all((fps[u] ^ fps[v]).bit_count() <= bits for u, v in edges)
        root = {}

        def find(x, root=root):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for u, v in edges:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
        assert all(find(i) == find(j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits)


def test_a_row_without_an_id_joins_its_neighbours(spark, monkeypatch):
    found = {"a": 0b0000, "b": 0b0111, "c": 0b111111}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words: docs.selectExpr("monotonically_increasing_id() uid", "doc_id", "fp"))
    docs = spark.createDataFrame([(5, found["a"]), (None, found["b"]), (2, found["c"])], "doc_id long, fp long")
    assert sorted(r.component_id for r in simhash.dedup(docs).collect()) == [2, 2, 2]


def test_whole_tables_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "the quick brown fox jumps"), (2, "the quick brown fox jumps"), (2, "the quick brown fox jumps"), (3, None), (4, ""), (5, "  "), (6, "something else entirely here now"), (None, "lone text without an id at all")]
    docs = spark.createDataFrame([(*r, 9, 8) for r in rows], "doc_id long, text string, fp int, component int")
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.component_id if r.component_id is not None else 99) for r in simhash.dedup(docs).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (99, 99)]
    assert simhash.dedup(docs.limit(0)).count() == 0
