"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer numpy network with a fitted temperature.

Words here are runs of letters, runs of digits and runs of other signs, hashed into `buckets`. Each bucket has a fixed sparse ternary index
vector (`signs` signs at different places); its word vector is the sum of the index vectors of the words up to `reach` before and after it, over all
documents, scaled to length 1. A task sums up what it reads, one row a bucket; the rows of a bucket are added on the executors; `buckets * dims` numbers
reach the driver at any size. A document is the mean of its words' vectors and the mean over its distinct words, nothing else.
The network (tanh layer, logistic output) is fitted on a bounded sample of labelled rows (`fit_rows`), `epochs` times over at any number of rows; a fifth of them, never
trained on, sets the temperature that its log-odds are divided by.

Defined cases: null and empty texts are pooled to zeros and scored like any other; very long texts are pooled whole; a score of exactly 0.7 is label 1 (the query's
rule); a doc_id with several labels counts as good if any is 1; rows that repeat a doc_id are scored each, one of them (the least text) is learned from; with labels of one
class only, or none, in an empty table too, the score is that share (0.5 without labels). Other columns pass through; if one has the result's name, ValueError
says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravel.llm import textcore as X
from ravel.llm.common import annotate
from ravel.llm.toxicity import sample


@dataclass(frozen=True)
class VectorOptions:
    buckets: int = 1 << 14
    dims: int = 64
    signs: int = 4
    reach: int = 2
    hidden: int = 32
    fit_rows: int = 20_000
    epochs: int = 120
    batch: int = 128
    rate: float = 0.003
    decay: float = 1e-4
    seed: int = 11


FIELDS = T.StructType([T.StructField("score", T.DoubleType())])
# Fixed classes of bytes: 0 space, 1 letters (all beyond ASCII), 2 digits, 3 other signs.
_KIND = np.array([0 if b == 0x20 or 9 <= b <= 13 else 1 if b >= 0x80 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)


def tokens(s: X.Slice, o: VectorOptions) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of a slice, and how many come before each document (one more at the end)."""
    kind = _KIND[s.data]
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(s.docs + 1, np.int64)
    cut = np.ones(n + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[s.off] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    h = s.spans_hash(s.prefix(s.data), starts, ends)
    return (h & np.uint64(o.buckets - 1)).astype(np.int64), np.searchsorted(starts, s.off)


def index_vectors(o: VectorOptions) -> np.ndarray:
    """The buckets' index vectors (int8, a row each): `signs` ones or minus ones at different places."""
    rng = np.random.default_rng(o.seed)
    out = np.zeros((o.buckets, o.dims), np.int8)
    n = min(o.signs, o.dims)
    place = np.argsort(rng.random((o.buckets, o.dims)), axis=1)[:, :n]
    np.put_along_axis(out, place, (rng.integers(0, 2, (o.buckets, n)) * 2 - 1).astype(np.int8), 1)
    return out


def neighbours(t: np.ndarray, before: np.ndarray, index: np.ndarray, o: VectorOptions) -> np.ndarray:
    """The sum of the index vectors around each word, within its document."""
    own = index[t].astype(np.int16)
    out = np.zeros_like(own)
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    for k in range(1, min(o.reach, len(t) - 1) + 1):
        out[k:] += own[:-k]
        out[:-k] += own[k:]
        other = np.flatnonzero(doc[k:] != doc[:-k])
        out[other + k] -= own[other]
        out[other] -= own[other + k]
    return out


def word_vectors(docs: DataFrame, o: VectorOptions) -> np.ndarray:
    """buckets x dims, rows of length 1 (or 0), from the neighbours of every word of all documents."""

    def rows(total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(total.any(1))
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([r.tobytes() for r in total[at]], pa.binary())], names=["b", "v"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors(o)
        total = np.zeros((o.buckets, o.dims), np.int64)
        for batch in batches:
            for s in X.slices(batch.column("text")):
                t, before = tokens(s, o)
                if len(t):
                    order = np.argsort(t, kind="stable")
                    bucket = t[order]
                    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                    total[bucket[at]] += np.add.reduceat(neighbours(t, before, index, o)[order], at, axis=0, dtype=np.int32)
        yield rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((o.buckets, o.dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.int64).reshape(-1, o.dims)
                np.add.at(total, np.asarray(batch.column("b")), v)
        yield rows(total)

    schema = "b int, v binary"
    got = docs.select("text").mapInArrow(collect, schema).repartition("b").mapInArrow(add, schema).toArrow()  # one row a bucket
    out = np.zeros((o.buckets, o.dims))
    if got.num_rows:
        out[np.asarray(got["b"])] = np.frombuffer(b"".join(got["v"].to_pylist()), np.int64).reshape(-1, o.dims)
    return (out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def pooled(s: X.Slice, vectors: np.ndarray, o: VectorOptions) -> np.ndarray:
    """A row for each document of a slice."""
    t, before = tokens(s, o)
    n = np.diff(before)
    out = np.zeros((s.docs, 2 * o.dims), np.float32)
    doc = np.repeat(np.arange(s.docs), n)
    key, count = X.sorted_counts(doc * o.buckets + t)
    d, b = key // o.buckets, key % o.buckets
    each = np.bincount(d, minlength=s.docs)
    at = np.flatnonzero(each)
    begin = (np.cumsum(each) - each)[at]
    if len(at):
        for lo in range(0, len(at), 256):  # some documents at a time, so that the gathered vectors stay small
            own = at[lo : lo + 256]
            a, z = begin[lo], begin[lo + 256] if lo + 256 < len(begin) else len(key)
            v = vectors[b[a:z]]
            out[own, : o.dims] = np.add.reduceat(v * count[a:z, None].astype(np.float32), begin[lo : lo + 256] - a, axis=0) / n[own, None]
            out[own, o.dims : 2 * o.dims] = np.add.reduceat(v, begin[lo : lo + 256] - a, axis=0) / each[own, None]
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / self.temperature, -30, 30)))


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, o: VectorOptions) -> Model:
    """Adam on the log loss, on all but every fifth row; then the temperature that suits those."""
    rng = np.random.default_rng(o.seed)
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        k = x.shape[1]
        return Model(vectors, np.zeros(k, np.float32), np.ones(k, np.float32), np.zeros((k, o.hidden), np.float32), np.zeros(o.hidden, np.float32), np.zeros(o.hidden, np.float32), float(np.log(share / (1 - share))), 1.0)
    order = rng.permutation(len(y))
    hold, fit = order[::5], np.delete(order, np.s_[::5])
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-4
    m = Model(vectors, mean, scale, (rng.standard_normal((x.shape[1], o.hidden)) / np.sqrt(x.shape[1])).astype(np.float32), np.zeros(o.hidden, np.float32), (rng.standard_normal(o.hidden) / np.sqrt(o.hidden)).astype(np.float32), 0.0, 1.0)
    p = [m.w1, m.b1, m.w2, np.zeros(1, np.float32)]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z, t = ((x - mean) / scale).astype(np.float32), 0
    for _ in range(o.epochs):
        rng.shuffle(fit)
        for lo in range(0, len(fit), o.batch):
            k = fit[lo : lo + o.batch]
            h = np.tanh(z[k] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[k]) / len(k)
            dh = e[:, None] * p[2] * (1 - h * h)
            grad = [z[k].T @ dh + o.decay * p[0], dh.sum(0), h.T @ e + o.decay * p[2], e.sum(keepdims=True)]
            t += 1
            for i, g in enumerate(grad):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p[i] = (p[i] - o.rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    m.w1, m.b1, m.w2, m.b2 = p[0], p[1], p[2], float(p[3][0])
    own = hold if len(hold) >= 20 and y[hold].min() != y[hold].max() else order
    odds = m.log_odds(x[own])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    m.temperature = float(min(grid, key=lambda c: np.mean(np.logaddexp(0, odds / c) - y[own] * odds / c)))
    return m


def fit(docs: DataFrame, labels: DataFrame, options: VectorOptions = VectorOptions(), label: str = "quality", vectors: np.ndarray | None = None) -> Model:
    """labels: doc_id and the label (0/1) of the rows to learn from. The word vectors use all documents, no labels (others may be given)."""
    vectors = word_vectors(docs, options) if vectors is None else vectors
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([pooled(s, shared.value, options) for s in X.slices(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("y")], names=["x", "y"])

    got = sample(docs, labels, label, options.fit_rows).mapInArrow(run, "x binary, y int").toArrow()  # fit_rows rows at most
    rows = sorted(zip(got["y"].to_pylist(), got["x"].to_pylist()))  # an order that doesn't depend on partitions
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(len(rows), 2 * options.dims)
    return train(vectors, x, np.array([r[0] for r in rows], np.float32), options)


def score(docs: DataFrame, model: Model, options: VectorOptions = VectorOptions(), name: str = "quality_model", drop_text: bool = False) -> DataFrame:
    """docs with the struct column `name` of FIELDS."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        return [pa.array(np.concatenate([m.probability(pooled(s, m.vectors, options)) for s in X.slices(batch.column("text"))]).astype(np.float64))]

    return annotate(docs, name, FIELDS, work, drop_text=drop_text)
