"""Toxicity: a logistic classifier over byte n-grams and words, regularised by counterfactual sentences.

Sentences are turned into the presence of hashed features (byte n-grams of the lower-cased text, so that stems inside compound words
count, and whole words). Fitting uses a bounded sample of the labelled rows (`fit_rows` documents, those with the least hash of doc_id):
1. document frequencies of all buckets by class (summed on the executors) choose the `features` most telling buckets; the word of every identity
   term has a feature in any case;
2. the presence bits of those come to the driver for each sampled document (fit_rows * features / 8 bytes at most), and so do those of one counterfactual
   set for each: a sentence of it, in one version for each member of a group of identity terms. In a sentence with identity terms each is swapped through its
   group; into one without, a term is put between two words, and the plain sentence is a version too. (Sentence, place and group follow the crc32 of the text.)
3. gradient descent minimises the log loss of the documents plus `penalty` * the mean over all sets of the variance of the versions' log-odds, plus a
   ridge (a convex sum). A weight that identity terms carry by accident is driven to zero, while insults keep theirs.
Scoring is one pass over all texts: every position's bucket is looked up in a table of the chosen features.

Defined cases: null and empty texts get the score of a text without features; very long texts are scored whole; a score of exactly 0.5 is label 1 (the query's
rule); documents with several labels count as toxic if any of them is 1; rows that repeat a doc_id are scored each, and one of them (the least text)
is learned from; without any labelled row of both classes, in an empty table too, the score is the share of toxic labels seen, or 0. Other columns pass through;
if one has the result's name, ValueError says so.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravel.llm import textcore as X
from ravel.llm.common import annotate, text_and_id

# Identity terms, in groups whose members may stand for each other.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("lesbian", "gay", "straight", "bisexual"), ("transgender", "cisgender"), ("homosexual", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("islam", "christianity", "judaism", "hinduism"),
    ("black", "white", "asian", "latino", "hispanic"), ("african", "european", "american", "arab"), ("blind", "deaf", "disabled"), ("old", "young"), ("immigrants", "refugees", "natives"), ("immigrant", "refugee", "native"),
    ("mexican", "chinese", "german", "french", "spanish", "russian"), ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"),
)


@dataclass(frozen=True)
class ToxicityOptions:
    buckets: int = 1 << 18
    gram: int = 5
    features: int = 1024
    fit_rows: int = 20_000
    penalty: float = 40.0
    #: Most letters of a counterfactual sentence.
    sentence: int = 300
    ridge: float = 1e-4
    rounds: int = 800
    #: Least absolute z value of a chosen feature, and least number of sampled documents with it.
    least_z: float = 4.0
    least_docs: int = 5


FIELDS = T.StructType([T.StructField("score", T.DoubleType())])
_LETTERS = X.table(lambda b: b >= 0x80 or 0x61 <= b <= 0x7A)


def swapper(groups=IDENTITY_TERMS, step: int = 1):
    """A function that puts in place of every identity term the one `step` places on in its group, keeping a first capital."""
    nxt = {t: g[(i + step) % len(g)] for g in groups for i, t in enumerate(g)}
    find = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, nxt), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)

    def put(m: re.Match) -> str:
        new = nxt.get(m[0].lower(), m[0])
        return new.capitalize() if m[0][:1].isupper() else new

    return lambda text: find.sub(put, text)


class Counterfactuals:
    """The versions of one sentence of a text that differ in identity terms alone."""

    def __init__(self, groups=IDENTITY_TERMS, longest: int = 300):
        self.groups, self.longest = groups, longest
        self.size = {t: len(g) for g in groups for t in g}
        self.steps = [swapper(groups, k) for k in range(max(map(len, groups)))]
        self.find = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, self.size), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)

    def of(self, text: str) -> list[str]:
        seed = zlib.crc32(text.encode())
        there = self.find.search(text)
        if there:
            lo = max((text.rfind(c, 0, there.start()) for c in "\n.!?"), default=-1) + 1
            ends = [i for i in (text.find(c, there.end()) for c in "\n.!?") if i >= 0]
            lo = max(lo, there.start() - self.longest // 2)
            frame = text[lo : min([there.end() + self.longest // 2, *ends])].strip()
            sizes = [self.size.get(m.lower(), 1) for m in self.find.findall(frame)]
            return [self.steps[k](frame) for k in range(max(sizes, default=1))]
        sentences = [x for x in re.split(r"[\n.!?]+", text) if x.strip()]
        frame = sentences[seed % len(sentences)].strip()[: self.longest] if sentences else ""
        words = frame.split()
        at = (seed >> 8) % (len(words) + 1)
        group = self.groups[(seed >> 16) % len(self.groups)]
        return [" ".join(words), *(" ".join([*words[:at], t, *words[at:]]) for t in group)]


def buckets_of(s: X.Slice, o: ToxicityOptions) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, byte position) of the features of a slice: n-grams, then words; each within one document."""
    data = X.LOWER[s.data]
    data = np.where(X.NOT_SPACE[data], data, np.uint8(32))
    n, m = o.gram, len(data) - o.gram + 1
    mask = np.uint64(o.buckets - 1)
    if m > 0:
        key = np.zeros(m, np.uint64)
        for k in range(n):
            key = (key << np.uint64(8)) | data[k : k + m]
        whole = np.ones(m, bool)
        for k in range(1, n):
            at = s.off[1:-1] - k
            whole[at[(at >= 0) & (at < m)]] = False
        at = np.flatnonzero(whole)
        yield (((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(37)) & mask).astype(np.int64)[at], at
    starts, ends, _ = s.words(_LETTERS[data])
    yield ((s.spans_hash(s.prefix(data), starts, ends) >> np.uint64(13)) & mask).astype(np.int64), starts


def presence(s: X.Slice, o: ToxicityOptions, chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, feature) pairs of a slice, in order; feature is the position in chosen, or the bucket if chosen is None."""
    keys = []
    for bucket, at in buckets_of(s, o):
        if chosen is not None:
            col = chosen[bucket]
            ok = col >= 0
            bucket, at = col[ok], at[ok]
        doc = np.searchsorted(s.off, at, "right") - 1
        keys.append(doc.astype(np.int64) * o.buckets + bucket)
    k = X.sorted_unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return k // o.buckets, k % o.buckets


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """text and y of at most `rows` labelled documents, those with the least hash of doc_id; the broadcast side has `rows` rows at most. Of documents
    that share a doc_id the one with the least text is taken (partial minima first, so that a doc_id of very many rows is one row a task)."""
    few = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return text_and_id(docs).join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")


def term_buckets(o: ToxicityOptions) -> np.ndarray:
    """The buckets of the identity terms' words, without repeats."""
    words = sorted({w for g in IDENTITY_TERMS for t in g for w in t.split()})
    return np.unique(np.concatenate([list(buckets_of(s, o))[-1][0] for s in X.slices(pa.array(words, pa.large_string()))]))


def width(o: ToxicityOptions) -> int:
    """Columns of the feature table: the chosen ones, the identity terms' words, up to a multiple of 8."""
    return -(-(o.features + len(term_buckets(o))) // 8) * 8


def choose(fit: DataFrame, o: ToxicityOptions) -> tuple[np.ndarray, int, int]:
    """The column of each bucket (-1: none), and the numbers of sampled documents of class 0 and 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros((2, o.buckets), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            y = np.asarray(batch.column("y"))
            docs += np.bincount(y, minlength=2)
            for s in X.slices(batch.column("text")):
                doc, bucket = presence(s, o, None)
                for c in (0, 1):
                    total[c] += np.bincount(bucket[y[s.lo + doc] == c], minlength=o.buckets).astype(np.int32)
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[0][at], docs[0]).astype(np.int64)), pa.array(np.append(total[1][at], docs[1]).astype(np.int64))], names=["b", "n0", "n1"])

    got = fit.mapInArrow(run, "b long, n0 long, n1 long").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    b, n0, n1 = (np.asarray(got[c]) for c in ("b", "n0", "n1"))
    d0, d1 = int(n0[b == -1].sum()), int(n1[b == -1].sum())
    b, n0, n1 = b[b >= 0], n0[b >= 0], n1[b >= 0]
    chosen = np.full(o.buckets, -1, np.int32)
    own = term_buckets(o)
    chosen[own] = np.arange(o.features, o.features + len(own), dtype=np.int32)
    if d0 and d1 and len(b):
        share = (n0 + n1) / (d0 + d1)
        z = (n1 / d1 - n0 / d0) / np.sqrt(share * (1 - share) * (1 / d0 + 1 / d1) + 1e-12)
        ok = np.flatnonzero((np.abs(z) >= o.least_z) & (n0 + n1 >= o.least_docs))
        ok = ok[chosen[b[ok]] < 0]
        ok = ok[np.lexsort((b[ok], -np.abs(z[ok])))][: o.features]
        chosen[b[ok]] = np.arange(len(ok), dtype=np.int32)
    return chosen, d0, d1


def fit_bits(fit: DataFrame, chosen: np.ndarray, o: ToxicityOptions) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Features (0/1) and y of the sampled documents, and the features of the versions of those counterfactual sets whose versions differ."""
    shared = fit.sparkSession.sparkContext.broadcast(chosen)
    made, columns = Counterfactuals(longest=o.sentence), width(o)

    def bits(texts: list[str]) -> list[bytes]:
        out = []
        for s in X.slices(pa.array(texts, pa.large_string())):
            m = np.zeros((s.docs, columns), bool)
            doc, col = presence(s, o, shared.value)
            m[doc, col] = True
            out += [x.tobytes() for x in np.packbits(m, axis=1)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            sets = [made.of(x) for x in texts]
            flat, at = bits([v for x in sets for v in x]), np.cumsum([0, *map(len, sets)]).tolist()
            versions = [b"".join(flat[a:b]) if len(set(flat[a:b])) > 1 else None for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bits(texts), pa.binary()), pa.array(versions, pa.binary()), batch.column("y")], names=["x", "versions", "y"])

    # fit_rows rows at most; sorted here, so that the order doesn't depend on partitions
    got = sorted(zip(*(c.to_pylist() for c in fit.mapInArrow(run, "x binary, versions binary, y int").toArrow().columns)), key=lambda r: (r[2], r[0], r[1] or b""))

    def grid(raw: bytes) -> np.ndarray:
        return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, columns // 8), axis=1)

    return grid(b"".join(r[0] for r in got)), np.array([r[2] for r in got], np.float32), [grid(r[1]) for r in got if r[1]]


def descend(x: np.ndarray, y: np.ndarray, sets: list[np.ndarray], o: ToxicityOptions) -> tuple[np.ndarray, float]:
    """Weights and bias, by Nesterov's method on the penalised loss; classes weigh the same."""
    x = x.astype(np.float32)
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / len(y)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    vw, vb = w.copy(), b
    mean_features = x.sum(1).mean()
    if sets:
        n = np.array([len(v) for v in sets])
        begin = np.cumsum(n) - n
        row, col = (np.concatenate(c) for c in zip(*((np.nonzero(v)[0] + at, np.nonzero(v)[1]) for v, at in zip(sets, begin.tolist()))))
        n_rows, many = int(n.sum()), np.repeat(n, n)

    def apart(v: np.ndarray) -> np.ndarray:
        """The gradient of the penalty, which is linear in the weights."""
        odds = np.bincount(row, v[col], n_rows)
        d = (2 * o.penalty / len(y)) * (odds - np.repeat(np.add.reduceat(odds, begin) / n, n)) / many
        return np.bincount(col, d[row], len(v)).astype(np.float32)

    curve = 0.0
    if sets:  # its greatest curvature, by power iteration
        v = np.random.default_rng(1).standard_normal(x.shape[1]).astype(np.float32)
        for _ in range(30):
            v = apart(v / max(np.linalg.norm(v), 1e-9))
        curve = 1.1 * float(np.linalg.norm(v))
    rate = np.float32(1 / ((1 + mean_features) / 4 + curve))
    for k in range(o.rounds):
        mu = np.float32(min(0.95, k / (k + 3)))
        aw, ab = w + mu * vw, b + mu * vb
        p = 1 / (1 + np.exp(-np.clip(x @ aw + ab, -30, 30)))
        g = (p - y) * weight
        gw, gb = x.T @ g + o.ridge * aw, g.sum()
        if sets:
            gw += apart(aw)
        vw, vb = mu * vw - rate * gw, mu * vb - rate * gb
        w, b = w + vw, b + vb
    return w.astype(np.float32), float(b)


@dataclass
class Model:
    chosen: np.ndarray
    weights: np.ndarray
    bias: float


def fit(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions(), label: str = "toxic") -> Model:
    """labels: doc_id and the label (0/1) of the rows to learn from."""
    few = sample(docs, labels, label, options.fit_rows)
    chosen, d0, d1 = choose(few, options)
    if not (d0 and d1):
        share = min(max(d1 / max(1, d0 + d1), 1e-6), 1 - 1e-6)
        return Model(chosen, np.zeros(width(options), np.float32), float(np.log(share / (1 - share))))
    w, b = descend(*fit_bits(few, chosen, options), options)
    return Model(chosen, w, b)


def score(docs: DataFrame, model: Model, options: ToxicityOptions = ToxicityOptions(), name: str = "toxicity", drop_text: bool = False) -> DataFrame:
    """docs with the struct column `name` of FIELDS."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        m = shared.value
        for s in X.slices(batch.column("text")):
            doc, col = presence(s, options, m.chosen)
            z = np.bincount(doc, m.weights[col], s.docs) + m.bias
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return [pa.array(np.concatenate(out))]

    return annotate(docs, name, FIELDS, work, drop_text=drop_text)
