"""Quality classifier: random-indexing word vectors pooled per document, then a small two-layer network.

Words are hashed into WORDS slots. Each slot has a fixed sparse index vector of -1, 0 and 1; a slot's word vector is
the sum of the index vectors of the words up to REACH places away, over all documents. A document is the mean and
the deviation of its words' vectors. The network is fitted on the driver on a sample of TRAIN_ROWS labelled rows,
and its logits are divided by the temperature that suits a part of the sample kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, only, span_hashes, text_slices, word_spans

WORDS, DIMS, ONES, REACH = 1 << 14, 32, 4, 2
SHARDS = 64
#: Labelled rows the network is fitted on at most (those with the least hash of doc_id), and the share for calibration.
TRAIN_ROWS, CALIBRATION = 20_000, 0.15
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-4


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(2_2)
    out = np.zeros((WORDS, DIMS), np.int16)
    for row in out:
        row[rng.choice(DIMS, ONES, replace=False)] = rng.choice([-1, 1], ONES)
    return out


def word_slots(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each word, and each document's first word."""
    starts, ends, first = word_spans(data, at)
    return (span_hashes(data, starts, ends) % np.uint64(WORDS)).astype(np.int64), first


def context_sums(slots: np.ndarray, first: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, sums of index vectors around them)."""
    n = len(slots)
    around = np.zeros((n, DIMS), np.int16)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k in range(1, REACH + 1):
        if n <= k:
            break
        same = (doc[k:] == doc[:-k])[:, None]
        around[:-k] += index[slots[k:]] * same
        around[k:] += index[slots[:-k]] * same
    order = np.argsort(slots, kind="stable")
    names, begin = np.unique(slots[order], return_index=True)
    return names, np.add.reduceat(around[order].astype(np.int64), begin, axis=0) if n else np.zeros((0, DIMS), np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors (WORDS by DIMS; 2 MB), from all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, index, some = np.zeros((WORDS, DIMS), np.int64), index_vectors(), False
        for _, data, at in text_slices(batches):
            names, sums = context_sums(*word_slots(data, at), index)
            total[names] += sums
            some = True
        if some:
            parts = total.reshape(SHARDS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHARDS)), pa.array([p.tobytes() for p in parts], pa.binary())], ["shard", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch.column("shard").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                part = np.frombuffer(raw, np.int64)
                total[s] = total[s] + part if s in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([p.tobytes() for p in total.values()], pa.binary())], ["shard", "sums"])

    kind = "shard long, sums binary"
    rows = only(docs, "text").mapInArrow(count, kind).repartition(SHARDS, "shard").mapInArrow(add, kind).collect()
    table = np.zeros((SHARDS, WORDS // SHARDS * DIMS), np.float64)
    for r in rows:
        table[r["shard"]] = np.frombuffer(bytes(r["sums"]), np.int64)
    table = table.reshape(WORDS, DIMS)
    size = np.linalg.norm(table, axis=1, keepdims=True)
    table = table / np.maximum(size, 1)
    return (table - table[size[:, 0] > 0].mean(0)).astype(np.float32) * (size > 0) if (size > 0).any() else table.astype(np.float32)


def features(data: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the word vectors of each document, and the logarithm of its number of words."""
    slots, first = word_slots(data, at)
    n = np.diff(first)
    out = np.zeros((len(n), 2 * DIMS + 1), np.float32)
    full = n > 0
    if full.any():
        words = vectors[slots]
        begin, size = first[:-1][full], n[full][:, None]
        mean = np.add.reduceat(words, begin, axis=0) / size
        square = np.add.reduceat(words * words, begin, axis=0) / size
        out[full, :DIMS] = mean
        out[full, DIMS : 2 * DIMS] = np.sqrt(np.maximum(0, square - mean * mean))
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Network:
    """Standardized inputs, one hidden layer of rectifiers, a logit and its temperature."""

    center: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(0, (x - self.center) / self.scale @ w1 + b1) @ w2 + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Fit by Adam in a fixed order of rows; without rows, or with one label only, a constant."""
    rng = np.random.default_rng(2)
    center, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1], np.float32), np.ones(x.shape[1], np.float32))
    share = (y.sum() + 1) / (len(y) + 2)
    bias = np.array([np.log(share / (1 - share))])
    if len(np.unique(y)) < 2:
        return Network(center, scale, [np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), bias])
    order = rng.permutation(len(x))
    apart = order[: max(1, int(CALIBRATION * len(x)))]
    rows = order[len(apart) :] if len(order) > 20 else order
    z = ((x - center) / scale).astype(np.float64)
    w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), bias]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    t = 0
    for _ in range(EPOCHS):
        rng.shuffle(rows)
        for i in range(0, len(rows), BATCH):
            part = rows[i : i + BATCH]
            a, target = z[part], y[part]
            h = np.maximum(0, a @ w[0] + w[1])
            d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -50, 50))) - target) / len(part)
            back = d[:, None] * w[2] * (h > 0)
            t += 1
            for k, g in enumerate((a.T @ back + DECAY * w[0], back.sum(0), h.T @ d + DECAY * w[2], np.array([d.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(center, scale, w)
    logits, target = net.logits(x[apart]), y[apart]

    def loss(temperature: float) -> float:
        s = logits / temperature
        return float(np.mean(np.logaddexp(0, s) - target * s))

    net.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=loss)
    return net


def remainder() -> Column:
    """crc32 of doc_id as text, mod 3; rows where it is 1 are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def labelled_features(docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of TRAIN_ROWS labelled rows at most, none of them held out."""
    spark = docs.sparkSession
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(remainder() != 1).select("doc_id", F.col("quality").cast("double").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "quality").limit(TRAIN_ROWS)
    shared = spark.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_slices(batches):
            x = features(data, at, shared.value)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # TRAIN_ROWS rows
    made = joined.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality double, x binary")
    chosen = made.orderBy(F.xxhash64("doc_id"), "quality", "x").limit(TRAIN_ROWS)  # documents may share an id
    rows = sorted((r["doc_id"], bytes(r["x"]), r["quality"]) for r in chosen.collect())
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(len(rows), 2 * DIMS + 1)
    return x, np.array([r[2] for r in rows])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    A null or empty text has features of zero and a score like any other; null ids are not held out; repeated ids
    keep a row each; labels other than 0 and 1 are left out and repeated ones count as often as they come. Without
    labels every score is one half. Extra columns are not read; an empty table gives no rows.
    """
    docs = only(docs, "doc_id", "text")
    vectors = word_vectors(docs)
    net = fit(*labelled_features(docs, only(labels, "doc_id", "quality"), vectors))
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, fitted = shared.value
        for rows, data, at in text_slices(batches):
            s = fitted.scores(features(data, at, table))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "text")
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
