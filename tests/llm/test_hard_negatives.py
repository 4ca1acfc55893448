import numpy as np
import pytest

from filewright.llm import hard_negatives, queries
from tests.llm.oracle import same
from tests.llm.test_vectors import ODD, frame, near_copies, usable


def labelled(spark, rows):
    return frame(spark, rows).withColumnRenamed("dims", "label").selectExpr("vec_id", "embedding", "label", "1 as uid", "2 as rank")


def brute(rows, every=50, positives=5, k=3):
    whole = [(n, i, [int(np.floor(256 * float(np.float32(c)))) for c in x], label) for n, (i, x, label) in enumerate(rows) if usable(x) and label is not None]
    out = []
    for n, i, q, label in whole:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j if j is not None else 10**9, m, other) for m, j, v, other in whole if m != n and len(v) == len(q))
        for s, positive, _, _ in [x for x in scored if x[3] == label][:positives]:
            found = [x for x in scored if x[3] != label and -50 * s <= -100 * x[0] <= -95 * s][:k]
            out += [(i, positive, r + 1, j, -s, -t) for r, (t, j, _, _) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    real = near_copies(rng, 400, 6, 6)
    listed = [[float(y) for y in x] for x in real] + [[float(y) for y in real[3]]] * 80 + ODD + [[float(y) for y in real[9]]] * 3
    ids = [*range(len(listed) - 1), 50]  # a repeated anchor
    labels = [int(x) if x < 4 else None for x in rng.integers(0, 5, len(listed))]
    labels[50], labels[-1], labels[100] = 1, 1, 2
    return [*zip(ids, listed, labels, strict=True), (None, [float(y) for y in real[50]], 1)]


@pytest.mark.parametrize("block", [4096, 60])
def test_negatives_match_brute_force(spark, rows, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 3)
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "STRIP", 4)
    got = [(a, p if p is not None else 10**9, r, n if n is not None else 10**9, s, t) for a, p, r, n, s, t in map(tuple, hard_negatives.mine(labelled(spark, rows)).collect())]
    want = brute(rows)
    assert len(want) > 50 and sorted(got) == want
    assert hard_negatives.mine(labelled(spark, rows).limit(0)).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [3e6, 1.0], 1), (1, [2e6, 5.0], 1), (2, [1.5e6, 7.0], 2), (3, [1e300, 1.0], 1), (4, [1.0, 1e5], 2), (50, [0.5, 0.25], 1), (51, [1.0, 1.0], 1), (52, [0.6, 0.6], 2)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    limit = 2**63 - 1
    first = {(r.anchor_id, r.positive_id): r for r in got}
    assert first[0, 1].negative_id == 2 and first[0, 1].positive_score == 768_000_000 * 512_000_000 + 256 * 1280
    assert first[50, 51].negative_id == 52 and all(r.positive_score <= limit for r in got)


def test_the_traversal_visits_near_rows_alone_and_misses_none(monkeypatch):
    rng = np.random.default_rng(3)
    real = near_copies(rng, 4000, 400, 8)
    rows = np.floor(256 * real / np.linalg.norm(real, axis=1)[:, None]).astype(np.int64)
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 32)
    tree, allowed, visits = hard_negatives.Tree(rows), rng.random(4000) < 0.7, []
    for at in range(0, 4000, 400):
        seeker, score = hard_negatives.Seeker(hard_negatives.Strip(tree, rows[at : at + 1]), 0), rows @ rows[at]
        for low, high in ((None, None), (int(score[at] * 0.5), int(score[at] * 0.95)), (int(score.max()) + 1, None)):
            annulus, before = hard_negatives.Annulus(low, high), seeker.visited
            good = np.flatnonzero(allowed & (score >= (low if low is not None else score.min())) & (score <= (high if high is not None else score.max())))
            want = good[np.lexsort((good, -score[good]))][:5]
            got = seeker.first(5, annulus, allowed)
            assert got == (want.tolist(), score[want].tolist())
            visits.append(seeker.visited - before)
    assert max(visits) < 4000 and np.mean(visits) < 2400


def test_query_matches_sql(spark):
    assert same(spark, queries.op11_hard_negatives, queries.OP11_SQL, "/root/testdata/sf0.01") > 0
