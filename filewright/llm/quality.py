"""A document quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned vector. Learned filters slide over the whole text in steps of half
their width; their responses are max-pooled over overlapping chunks, and the mean and the maximum
over all chunks give one probability. The network is fitted on a bounded sample of labelled rows
and its weights, a few kilobytes, travel with the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.llm._shared import small_batches

THRESHOLD = 0.3
#: Labelled rows that the network is fitted on at most, and excerpts taken of each of them.
SAMPLE_ROWS, EXCERPTS = 4000, 8
FILTERS, DEPTH, STEP = 24, 8, 4  # a filter spans two steps of bytes
UNIT, CHUNK, HOP = 32, 4, 2  # steps in a unit, units in a chunk, units between chunks
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.004, 11
#: Steps that are filtered at once; bounds memory for very long texts.
AT_ONCE = 1 << 16


@dataclass
class Network:
    table: np.ndarray  # 256 x DEPTH
    filters: np.ndarray  # FILTERS x (2 * STEP * DEPTH)
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS
    offset: float

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Mean and maximum over the chunks of each text, as rows."""
        unit = UNIT * STEP
        sizes = np.array([len(x) // unit + 1 for x in texts])  # room for a step of zeros at the end
        buffer = np.zeros(int(sizes.sum()) * unit, np.uint8)
        ends = np.cumsum(sizes)
        for text, end, size in zip(texts, ends, sizes, strict=True):
            at = int(end - size) * unit
            if len(text) % unit > unit - STEP:  # the last step is not all zeros, so it gets a unit more
                return self._one_by_one(texts)
            buffer[at : at + len(text)] = np.frombuffer(text, np.uint8)
        return self._units(buffer, sizes, ends)

    def _one_by_one(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        unit = UNIT * STEP
        padded = [x + b"\0" * (unit - len(x) % unit) if len(x) % unit > unit - STEP else x for x in texts]
        return self.pooled(padded)

    def _units(self, buffer: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.filters.reshape(FILTERS, 2, STEP * DEPTH)
        both = np.concatenate([half[:, 0], half[:, 1]]).T.astype(np.float32)
        table, steps = self.table.astype(np.float32), len(buffer) // STEP
        last = np.zeros(steps, bool)
        last[ends * UNIT - 1] = True  # no filter reaches from one text into the next
        units = np.empty((steps // UNIT, FILTERS), np.float32)
        for at in range(0, steps, AT_ONCE):
            to = min(at + AT_ONCE, steps)
            ahead = min(to + 1, steps)
            part = table[buffer[at * STEP : ahead * STEP]].reshape(ahead - at, STEP * DEPTH) @ both
            response = part[: to - at, :FILTERS].copy()
            response[: ahead - at - 1] += part[1:, FILTERS:]
            response[last[at:to]] = -np.inf
            units[at // UNIT : to // UNIT] = response.reshape(-1, UNIT, FILTERS).max(axis=1)
        counts = np.maximum(1, -(-(sizes - CHUNK) // HOP) + 1)
        first = np.repeat(ends - sizes, counts)
        begin = np.cumsum(counts) - counts
        at = first + HOP * (np.arange(counts.sum()) - np.repeat(begin, counts))
        stop = np.repeat(ends - 1, counts)
        chunk = units[at]
        for k in range(1, CHUNK):
            np.maximum(chunk, units[np.minimum(at + k, stop)], out=chunk)
        hidden = np.maximum(chunk + self.bias.astype(np.float32), 0)
        return np.add.reduceat(hidden, begin, axis=0) / counts[:, None], np.maximum.reduceat(hidden, begin, axis=0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        mean, most = self.pooled(texts)
        logit = mean @ self.weights[:FILTERS] + most @ self.weights[FILTERS:] + self.offset
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30).astype(np.float64)))


def fit(excerpts: list[list[bytes]], labels: np.ndarray) -> Network:
    """Fit on lists of excerpts, each one chunk long at most, with labels 0 and 1, by Adam."""
    rng = np.random.default_rng(SEED)
    size = CHUNK * UNIT * STEP
    rows, owner = [], []
    for n, some in enumerate(excerpts):
        for x in some or [b""]:
            rows.append(np.frombuffer(x[:size].ljust(size, b"\0"), np.uint8))
            owner.append(n)
    data, owner = np.stack(rows) if rows else np.zeros((0, size), np.uint8), np.array(owner, int)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    p = {
        "table": rng.normal(0, 0.5, (256, DEPTH)),
        "filters": rng.normal(0, 1 / np.sqrt(2 * STEP * DEPTH), (FILTERS, 2 * STEP * DEPTH)),
        "bias": np.zeros(FILTERS),
        "weights": rng.normal(0, 0.1, 2 * FILTERS),
        "offset": np.array([np.log(prior / (1 - prior))]),
    }
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    start = np.searchsorted(owner, np.arange(len(labels) + 1))
    for epoch in range(EPOCHS if 0 < labels.sum() < len(labels) else 0):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), BATCH):
            docs = order[a : a + BATCH]
            pick = np.concatenate([np.arange(start[d], start[d + 1]) for d in docs])
            counts = start[docs + 1] - start[docs]
            begin = np.cumsum(counts) - counts
            grad = _gradient(p, data[pick], counts, begin, labels[docs])
            t += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Network(p["table"], p["filters"], p["bias"], p["weights"], float(p["offset"][0]))


def _gradient(p: dict, data: np.ndarray, counts: np.ndarray, begin: np.ndarray, labels: np.ndarray) -> dict:
    chunks, size = data.shape
    steps = size // STEP
    half = p["filters"].reshape(FILTERS, 2, STEP * DEPTH)
    vectors = p["table"].astype(np.float32)[data].reshape(chunks * steps, STEP * DEPTH)
    part = (vectors @ np.concatenate([half[:, 0], half[:, 1]]).T.astype(np.float32)).reshape(chunks, steps, 2 * FILTERS)
    response = part[:, :-1, :FILTERS] + part[:, 1:, FILTERS:]
    best = response.argmax(axis=1)
    hidden = np.take_along_axis(response, best[:, None, :], axis=1)[:, 0] + p["bias"]
    active = np.maximum(hidden, 0)
    mean, most = np.add.reduceat(active, begin) / counts[:, None], np.maximum.reduceat(active, begin)
    logit = mean @ p["weights"][:FILTERS] + most @ p["weights"][FILTERS:] + p["offset"][0]
    error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(labels)
    to = np.repeat(np.arange(len(counts)), counts)
    down = (error[:, None] * p["weights"][:FILTERS] / counts[:, None])[to] + (error[:, None] * p["weights"][FILTERS:])[to] * (active == most[to])
    down *= hidden > 0
    at = best * STEP
    window = data[np.arange(chunks)[:, None, None], at[:, :, None] + np.arange(2 * STEP)]  # chunk, filter, byte
    seen = p["table"][window].reshape(chunks, FILTERS, -1)
    grad_table = np.zeros_like(p["table"])
    np.add.at(grad_table, window.reshape(-1), (down[:, :, None] * p["filters"][None]).reshape(-1, DEPTH))
    return {
        "table": grad_table,
        "filters": np.einsum("cf,cfk->fk", down, seen) + 1e-4 * p["filters"],
        "bias": down.sum(axis=0),
        "weights": np.concatenate([error @ mean, error @ most]) + 1e-3 * p["weights"],
        "offset": np.array([error.sum()]),
    }


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Fit on at most SAMPLE_ROWS rows that are not held out, the first in the order of a hash.

    Each row gives up to EXCERPTS evenly spaced excerpts of one chunk. Rows with a null label, ids
    with both labels and labels of no document are passed over; with no labels at all the network
    scores one half.
    """
    size = CHUNK * UNIT * STEP
    chosen = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    bounded = F.broadcast(chosen)  # SAMPLE_ROWS rows of two numbers
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length("data")
    spread = F.greatest(F.lit(1), F.least(F.lit(EXCERPTS), F.ceil(n / size))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), spread - 1), lambda i: F.substring(F.col("data"), (F.floor(i * F.greatest(n - size, F.lit(0)) / F.greatest(spread - 1, F.lit(1))) + 1).cast("int"), F.lit(size)))
    rows = docs.select("doc_id", data.alias("data")).join(bounded, "doc_id").select("doc_id", "quality", cut.alias("excerpts")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).collect()
    return fit([[bytes(x) for x in r.excerpts] for r in rows], np.array([r.quality for r in rows], float))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with score double: the probability of quality 1 of every whole text.

    A null or empty text is scored as one chunk of padding. No other column is looked at; all of
    them are kept, but one named score is replaced. Repeated rows and null ids stay as rows, and an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(network.score([x or b"" for x in texts]))

    return docs.withColumn("score", of(F.col("text").cast("binary")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score and predicted; columns of these names are replaced."""
    scored = score(docs, train(docs, labels))
    return scored.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text the classifier accepts, with their columns as they are."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text")
    scored = score(whole, train(docs, labels)).where(F.col("score") >= threshold)
    return scored.select(*("text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
