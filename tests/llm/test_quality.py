import zlib

import numpy as np
import pytest

from filewright.llm import quality, queries

WORDS = "the of and river stone light under over walks green paper seven quiet window".split()


def corpus(n=400):
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for i in range(n):
        words = [WORDS[k] for k in rng.integers(0, len(WORDS), rng.integers(20, 200))]
        good = bool(rng.random() < 0.7)
        docs.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        if i % 4:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_contract(spark, tmp_path):
    docs, labels = corpus()
    odd = [(1000, None), (1001, ""), (1002, "word " * 200_000), (None, "no id"), (3, "a repeated id")]
    spark.createDataFrame([(*d, "x", 0.5) for d in [*docs, *odd]], "doc_id long, text string, source string, predicted double").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels, (1, None, None), (5000, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op8_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) + len(odd)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_batches_do_not_change_scores_and_every_byte_counts():
    rng = np.random.default_rng(1)
    net = quality.Network(rng.normal(size=(256, quality.DEPTH)), rng.normal(size=(quality.FILTERS, 2 * quality.STEP * quality.DEPTH)), rng.normal(size=quality.FILTERS), rng.normal(size=2 * quality.FILTERS), 0.1)
    texts = [rng.integers(1, 256, n).astype(np.uint8).tobytes() for n in [0, 1, 3, 4, 123, 124, 125, 127, 128, 129, 500, 3000, 300_000]]
    together = net.score(texts)
    assert np.allclose(together, [net.score([x])[0] for x in texts], atol=1e-5)
    tail = net.pooled([b"a" * 5000 + b"qzxjkvbw" * 2])[1]
    assert not np.array_equal(tail, net.pooled([b"a" * 5000 + b"a" * 16])[1])


def naive_score(net, text):
    """One text by loops over its steps: filters, units of steps, chunks of units."""
    step, unit = quality.STEP, quality.UNIT
    steps = (len(text) + step - 1) // step + 1
    steps = -(-steps // unit) * unit  # a step of zeros at the end, then whole units
    data = np.frombuffer(text.ljust(steps * step, b"\0"), np.uint8)
    response = [net.filters @ net.table[data[s * step : (s + 2) * step]].reshape(-1) for s in range(steps - 1)]
    units = [np.max(response[u * unit : (u + 1) * unit], axis=0) for u in range(steps // unit)]
    begins = range(0, max(1, len(units) - quality.CHUNK + quality.HOP), quality.HOP)
    hidden = [np.maximum(np.max(units[b : b + quality.CHUNK], axis=0) + net.bias, 0) for b in begins]
    logit = np.mean(hidden, axis=0) @ net.weights[: quality.FILTERS] + np.max(hidden, axis=0) @ net.weights[quality.FILTERS :] + net.offset
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def test_scores_match_a_naive_scorer():
    rng = np.random.default_rng(6)
    net = quality.Network(rng.normal(size=(256, quality.DEPTH)) / 4, rng.normal(size=(quality.FILTERS, 2 * quality.STEP * quality.DEPTH)) / 4, rng.normal(size=quality.FILTERS), rng.normal(size=2 * quality.FILTERS) / 9, 0.1)
    for n in [0, 1, 5, 126, 128, 400, 511, 512, 513, 900, 1281, 5000]:
        text = rng.integers(1, 256, n).astype(np.uint8).tobytes()
        assert net.score([text])[0] == pytest.approx(naive_score(net, text), abs=1e-4)


def test_accepted_rows_keep_their_columns_and_conflicting_labels_are_passed_over(spark):
    docs, labels = corpus(120)
    frame = spark.createDataFrame([(*d, 5.0, "p") for d in docs], "doc_id long, text string, score double, predicted string")
    twice = spark.createDataFrame([*labels, *((i, 1 - q, 0) for i, q, _ in labels[:9])], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(labels[9:], "doc_id long, quality int, toxic int")
    kept = quality.accepted(frame, twice).collect()
    assert 0 < len(kept) < 120 and all(r.score == 5.0 and r.predicted == "p" for r in kept)
    assert sorted(kept) == sorted(quality.accepted(frame, once).collect())


def test_gradient_matches_differences():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, (5, quality.CHUNK * quality.UNIT * quality.STEP)).astype(np.uint8)
    p = {"table": rng.normal(size=(256, quality.DEPTH)), "filters": rng.normal(size=(quality.FILTERS, 2 * quality.STEP * quality.DEPTH)) / 8, "bias": rng.normal(size=quality.FILTERS), "weights": rng.normal(size=2 * quality.FILTERS) / 9, "offset": np.zeros(1)}
    counts, begin, labels = np.array([2, 3]), np.array([0, 2]), np.array([1.0, 0.0])
    net = lambda q: quality.Network(q["table"], q["filters"], q["bias"], q["weights"], float(q["offset"][0]))

    def loss(q):
        half = q["filters"].reshape(quality.FILTERS, 2, -1)
        part = (q["table"][data].reshape(-1, quality.STEP * quality.DEPTH) @ np.concatenate([half[:, 0], half[:, 1]]).T).reshape(5, -1, 2 * quality.FILTERS)
        active = np.maximum((part[:, :-1, : quality.FILTERS] + part[:, 1:, quality.FILTERS :]).max(axis=1) + q["bias"], 0)
        n = net(q)
        logit = (np.add.reduceat(active, begin) / counts[:, None]) @ n.weights[: quality.FILTERS] + np.maximum.reduceat(active, begin) @ n.weights[quality.FILTERS :] + n.offset
        return np.mean(np.log1p(np.exp(logit)) - labels * logit)

    grad = quality._gradient(p, data, counts, begin, labels)
    for key, at in (("bias", (3,)), ("weights", (5,)), ("filters", (2, 7)), ("offset", (0,))):
        up, down = {k: v.copy() for k, v in p.items()}, {k: v.copy() for k, v in p.items()}
        up[key][at] += 1e-5
        down[key][at] -= 1e-5
        decay = {"filters": 1e-4, "weights": 1e-3}.get(key, 0) * p[key][at]
        assert grad[key][at] - decay == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-4)
