import numpy as np
import pytest

from filewright.llm import embed_dedup, topk

ODD = [None, [], [0.0, 0.0, 0.0, 0.0], [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0], [1.0, 0.0]]


def near_copies(rng, n, groups, dims=4):
    base = rng.normal(size=(groups, dims))
    return (base[rng.integers(0, groups, n)] + rng.normal(0, 0.15, (n, dims))).astype(np.float32)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    real = near_copies(rng, 120, 25)
    listed = [[float(y) for y in x] for x in real] + [[float(y) for y in real[3]]] * 5 + ODD
    ids = [*range(len(listed) - 1), 3]  # a repeated id
    return [*zip(ids, listed, [7] * len(listed), strict=True), (None, [float(y) for y in real[4]], 7)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, dims int")


def usable(x):
    return bool(x) and None not in x and np.isfinite(x).all()


def brute_links(rows, threshold=0.9):
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = rows[i][1], rows[j][1]
            if i != j and usable(a) and usable(b) and len(a) == len(b) and any(a) and any(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                link[i, j] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold
    label = list(range(n))
    while True:
        now = [min([label[i], *(label[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if now == label:
            break
        label = now
    least = {c: min((rows[i][0] for i in range(n) if label[i] == c and rows[i][0] is not None), default=None) for c in label}
    return sorted((rows[i][0] if rows[i][0] is not None else -1, int(link[i].sum()), least[label[i]]) for i in range(n))


@pytest.mark.parametrize("tile", [8192, 16])
def test_links_and_components_match_brute_force(spark, rows, monkeypatch, tile):
    monkeypatch.setattr(embed_dedup, "TILE_ROWS", tile)
    got = embed_dedup.dedup(frame(spark, rows)).collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id) for r in got) == brute_links(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert embed_dedup.dedup(frame(spark, rows).limit(0)).count() == 0
    assert [tuple(r) for r in embed_dedup.dedup(frame(spark, [(4, None, 1)])).collect()] == [(4, 0, 4, True)]


def test_sparse_and_dense_strips_agree():
    rng = np.random.default_rng(1)
    unit = near_copies(rng, 700, 3, 16).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1]
    got = {(i, j) for x, y in embed_dedup.linked(unit, unit, axes, 0.9) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(unit @ unit.T >= 0.9)), strict=True))


def brute_topk(rows, k):
    out = []
    whole = [(n, i, np.floor(64 * np.array(x, np.float32).astype(float)).astype(int)) for n, (i, x, _) in enumerate(rows) if usable(x)]
    for n, i, q in whole:
        if i is not None and i % 20 == 0:
            found = sorted((-(q @ v), j if j is not None else 10**9, m) for m, j, v in whole if m != n and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 40])
def test_topk_matches_brute_force(spark, rows, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    got = [tuple(r) for r in topk.search(frame(spark, rows)).collect()]
    assert sorted((q, r, v if v is not None else 10**9, s) for q, r, v, s in got) == brute_topk(rows, 20)
    assert topk.search(frame(spark, rows).limit(0)).count() == 0


def test_index_proves_rows_out_and_keeps_every_member():
    rng = np.random.default_rng(2)
    rows = rng.integers(-30, 30, (3000, 32))
    rows[:50] = rows[0] + rng.integers(-3, 3, (50, 32))
    index = topk.Index(rows)
    for q in [*range(5), 100, 200]:
        left = index.possible(rows[q], 20, np.array([q]))
        score = rows @ rows[q]
        score[q] = -(10**9)
        assert set(np.argsort(-score, kind="stable")[:20].tolist()) <= set(left.tolist())
    assert len(index.possible(rows[1], 20, np.array([1]))) <= 80
    assert set(index.possible(np.zeros(32, int), 20, np.array([1])).tolist()) == set(range(3000)) - {1}


def test_strips_of_queries_prove_rows_out_at_any_level(monkeypatch):
    rng = np.random.default_rng(4)
    rows = rng.integers(-30, 30, (1000, 16))
    rows[:, 3], rows[:, 5] = 7, rng.integers(0, 2, 1000)  # lists of one value and of two
    rows[200:230] = rows[200]
    index, queries = topk.Index(rows), np.concatenate([rows[::20], np.zeros((1, 16), int), 10**6 * rows[:1]])
    own = [np.array([n]) for n in [*range(0, 1000, 20), 1, 2]]
    score = queries.astype(object) @ rows.T.astype(object)
    monkeypatch.setattr(topk, "STRIP", 7)
    for levels in ((0.5, 0.2, 0.0), (0.1, 0.0), (0.0,)):
        monkeypatch.setattr(topk, "LEVELS", levels)
        for n, left in enumerate(index.each_possible(queries, 20, own)):
            best = sorted(set(range(1000)) - {int(own[n][0])}, key=lambda i: -score[n, i])
            ties = {i for i in best if score[n, i] >= score[n, best[19]]}
            assert ties <= set(left.tolist()) and own[n][0] not in left
    assert len(left) == 999 and len(list(index.each_possible(queries[:0], 20, []))) == 0


def test_large_components_take_part(spark):
    rows = [(20, [300000.0, 1.0]), (1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [1e9, -1.0]), (40, [1e300, 0.0]), (60, [0.5, 0.25])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(64 * x) if abs(x) > 1e17 else int(np.floor(64 * x)) for x in v] for i, v in rows}
    got = {}
    for r in topk.search(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    limit = 2**63
    for q in (20, 40, 60):
        score = {i: sum(a * b for a, b in zip(whole[q], v, strict=True)) for i, v in whole.items() if i != q}
        assert [i for i, _ in got[q]] == sorted(score, key=lambda i: (-score[i], i))
        assert [s for _, s in got[q]] == [max(-limit, min(limit - 1, score[i])) for i, _ in got[q]]


def test_lengths_beyond_squares_link(spark):
    rows = [(1, [1e300, 1e300]), (2, [1.0, 1.0]), (3, [1e-300, 1e-300]), (4, [1.0, -1.0]), (None, [2.0, 2.0])]
    got = embed_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 9, r.n_links, r.component_id, r.kept) for r in got) == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (9, 3, 1, False)]
    alone = embed_dedup.dedup(spark.createDataFrame([(None, [1.0])], "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in alone] == [(None, 0, None, True)]


def test_each_step_of_the_axes_keeps_what_can_reach():
    rng = np.random.default_rng(8)
    unit = near_copies(rng, 200, 20, 16).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    turned = embed_dedup.Rotated(unit, np.linalg.eigh(unit.T @ unit)[1][:, ::-1])
    assert len(turned.cuts) == 4 and np.allclose(turned.suffix[-1], 0, atol=1e-6)
    x, y = (z.ravel() for z in np.indices((200, 200)))
    kept = set(zip(*(z.tolist() for z in embed_dedup._reaching(turned, turned, x, y, 0.9)), strict=True))
    reach = {(i, j) for i, j in zip(*(z.tolist() for z in np.nonzero(unit @ unit.T >= 0.9)), strict=True)}
    assert reach <= kept and len(kept) < len(reach) + 50
