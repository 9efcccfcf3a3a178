"""LM scoring: a log-bilinear model trained in numpy with noise-contrastive estimation, normalised, beside an exact unigram base.

Tokens are the words [^\\x20\\x09-\\x0D]+ of the text (A-Z lower-cased), then one end token. All training tokens are counted, by 64-bit
hash; the counts stay a distributed table. The `words` most frequent tokens (of `least_count` or more, the end among them) have vectors of their own, as targets and as contexts; any
other word is a context by one of `tail` vectors that its hash picks, and a target in the class "rare". The words are dealt in order of frequency
into `classes` classes of equal mass. With r the vectors of the two tokens before a token, h = r[w-1] C1 + r[w-2] C2:
    P(class | context) = softmax of h . u[class] + a[class] over all classes and "rare",
    P(word | class, context) = softmax of h . q[word] + b[word] over the words of the class,
and a rare word has P(rare | context) * (count + 1) / (rare tokens + rare words + 1), so the whole distribution sums to 1. As classes have equal mass a token costs
classes + words / classes scores on average.

Training: the training texts are dealt evenly over trainers, one for every `trainer_tokens` tokens, however the input is split into files; each runs minibatch NCE over
all its tokens, from one starting point: noise classes by their frequencies, noise words by
theirs within a class, shared by a batch, so that scores are matrix products. The parameters are averaged on the executors: a word's by the tokens that
each trainer has learned it from, so that those which never met it do not count; the others' by all tokens. The number of trainers follows the tokens
alone; which texts one gets, and in which order, follows the input's order, so scores of differently ordered inputs differ a little.
Scoring: tokens are sorted by class; matrix products give the scores of all classes and of the words of each token's class, and so exactly
normalised log-probabilities. Counts of the `hot` most frequent words are broadcast (a bound, 16 bytes each); the other words of the documents
meet the count table in a join, so nothing is left out.

Defined cases: null and empty texts are one end token; very long texts are scored whole; of equally frequent words those with the lesser hash have vectors; repeated
rows are counted and scored as often as they come; a null key is scored and not held out, and is learned from only if `train` says so; without any training row counts
are 0 and every token is in the rare class; an empty table gives no rows. Only the four columns named at lm_scores are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.llm import textcore as X
from ravel.llm.common import cut


@dataclass(frozen=True)
class LmOptions:
    words: int = 1 << 15
    #: Least count of a word with vectors of its own.
    least_count: int = 5
    classes: int = 256
    tail: int = 4096
    dims: int = 32
    hot: int = 1 << 17
    batch: int = 4096
    #: Noise classes of a batch, noise words of a class in it, and how many of them count for a token.
    noise: int = 64
    word_noise: int = 16
    noise_per_token: float = 16.0
    rate: float = 0.25
    #: The biases begin at the unigram's values, so they move by smaller steps.
    bias_rate: float = 0.02
    #: Training tokens for which there is a trainer.
    trainer_tokens: int = 1 << 23
    seed: int = 5


END = np.uint64(0x6A09E667F3BCC909)
#: Words counted together before they are handed to Spark.
_HELD = 2_000_000
#: Tokens scored together; the scores of a block of them are made some rows at a time.
_BLOCK = 1 << 16
#: Tokens of a class in one product when training.
_PIECE = 32
#: Leading bits of a hash that a search begins with.
_LEADING = 19


def tokens(s: X.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a slice, each document's end included, and how many come before each document (one more at the end)."""
    data = X.LOWER[s.data]
    starts, ends, before = s.words(X.NOT_SPACE[data])
    h = s.spans_hash(s.prefix(data), starts, ends)
    out = np.full(len(h) + s.docs, END, np.uint64)
    doc = np.repeat(np.arange(s.docs), np.diff(before))
    out[np.arange(len(h)) + doc] = h
    return out, before + np.arange(s.docs + 1)


def counts(docs: DataFrame) -> DataFrame:
    """h, c: how often each token occurs in docs (text), as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            h, c = X.sorted_counts(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(X.signed(h)), pa.array(c.astype(np.int64))], names=["h", "c"])

        for batch in batches:
            for s in X.slices(batch.column("text")):
                held.append(tokens(s)[0])
                size += len(held[-1])
                if size >= _HELD:
                    yield rows()
                    held, size = [], 0
        if size:
            yield rows()

    return cut(docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "counts")


@dataclass
class Vocabulary:
    """n, v: all tokens and distinct ones. h, c: the hot words, sorted by hash, with counts; own: the number of those with vectors, -1 for the others.
    counts: of the words with vectors, by number; begin: the first number of each class, one more at the end. least: all words with that count or more are hot."""

    n: int
    v: int
    h: np.ndarray
    c: np.ndarray
    own: np.ndarray
    counts: np.ndarray
    begin: np.ndarray
    least: int

    @property
    def rare_tokens(self) -> float:
        return float(self.n - self.counts.sum())

    @property
    def rare_total(self) -> float:
        """Tokens and distinct words of the rare class, and 1."""
        return float(self.rare_tokens + self.v - len(self.counts) + 1)

    @property
    def classes(self) -> int:
        """Without the rare one, which comes after them."""
        return len(self.begin) - 1

    @cached_property
    def first(self) -> np.ndarray:
        """How many hot words are less than each multiple of 2 ** (64 - _LEADING): where a search for a hash begins."""
        return np.searchsorted(self.h, np.arange(1 << _LEADING, dtype=np.uint64) << np.uint64(64 - _LEADING)).astype(np.int32)

    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.classes), np.diff(self.begin)).astype(np.int32)


def dealt(counts: np.ndarray, classes: int) -> np.ndarray:
    """The first number of each class of about equal mass, and the number of words."""
    if not len(counts):
        return np.zeros(1, np.int64)
    middle = (np.cumsum(counts) - counts / 2) / counts.sum()
    cls = np.minimum((middle * classes).astype(np.int64), classes - 1)
    return np.append(np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])), len(counts))


def vocabulary(table: DataFrame, o: LmOptions) -> Vocabulary:
    """The hot words are those of the highest count levels (eighths of a power of two) that together have at most o.hot words."""
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = sorted(((r[0], r[1], r[2], r[3]) for r in table.groupBy(level.alias("l")).agg(F.count(F.lit(1)), F.sum("c"), F.min("c")).collect()), reverse=True)
    n, v = sum(x[2] for x in levels), sum(x[1] for x in levels)
    least, size = (1 << 62), 0
    for _, words, _, low in levels:
        if size + words > o.hot:
            break
        size, least = size + words, low
    got = table.filter(F.col("c") >= least).toArrow()
    h, c = np.asarray(got["h"]).view(np.uint64), np.asarray(got["c"])
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.lexsort((h, -c))[: min(o.words, int((c >= o.least_count).sum()))]
    own = np.full(len(h), -1, np.int32)
    own[first] = np.arange(len(first))
    return Vocabulary(n, v, h, c, own, c[first].astype(np.float64), dealt(c[first], o.classes), least)


def look_up(v: Vocabulary, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each token among the hot words, and whether it is one."""
    if not len(v.h):
        return np.zeros(len(t), np.int64), np.zeros(len(t), bool)
    at = np.minimum(v.first.take((t >> np.uint64(64 - _LEADING)).astype(np.int32)), len(v.h) - 1)
    found = v.h.take(at)
    # hashes are even, so few share their leading bits: a step at a time for those that are not there yet
    left = np.flatnonzero((found < t) & (at < len(v.h) - 1))
    while len(left):
        at[left] += 1
        found[left] = v.h.take(at[left])
        left = left[(found[left] < t[left]) & (at[left] < len(v.h) - 1)]
    return at, found == t


def numbers(v: Vocabulary, t: np.ndarray, before: np.ndarray, o: LmOptions) -> tuple[np.ndarray, ...]:
    """Of each token: place among the hot words, whether it is hot, its number (-1: rare), and the context vectors one and two tokens back."""
    at, hot = look_up(v, t)
    own = np.where(hot, v.own[at] if len(v.own) else -1, -1).astype(np.int32)
    w = len(v.counts)
    as_context = np.where(own >= 0, own, w + (t % np.uint64(o.tail)).astype(np.int32)).astype(np.int32)
    return at, hot, own, *contexts(as_context, before, w + o.tail)


def contexts(cls: np.ndarray, before: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """What stands one and two tokens back; `start` at a document's beginning."""
    one, two = np.full(len(cls), start, np.int32), np.full(len(cls), start, np.int32)
    one[1:], two[2:] = cls[:-1], cls[:-2]
    begin = before[:-1]
    one[begin] = start
    two[begin] = start
    second = begin + 1
    two[second[second < before[1:]]] = start
    return one, two


def begin(v: Vocabulary, o: LmOptions) -> list[np.ndarray]:
    """r, C1, C2, q, b, u, a before training: b and a are smoothed log frequencies, so the model starts as the base."""
    w, k = len(v.counts), v.classes + 1
    rng = np.random.default_rng(o.seed)
    mass = class_mass(v)
    one = np.eye(o.dims, dtype=np.float32)
    small = lambda n: (0.1 * rng.standard_normal((n, o.dims))).astype(np.float32)
    return [small(w + o.tail + 1), one.copy(), 0.5 * one, small(w), np.log(v.counts + 1).astype(np.float32), small(k), np.log(mass).astype(np.float32)]


def class_mass(v: Vocabulary) -> np.ndarray:
    """Shares of the classes, the rare one last, with one more for each word and for what is unseen, as in the base."""
    total = np.append(np.add.reduceat(v.counts + 1, v.begin[:-1]) if len(v.counts) else [], v.rare_total)
    return total / total.sum()


def sigmoid(minus: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """scale / (1 + exp(minus)) in place: of scores of the other sign."""
    with np.errstate(over="ignore"):  # then it is 0
        np.exp(minus, out=minus)
    minus += 1
    return np.divide(np.float32(scale), minus, out=minus)


def sorted_order(x: np.ndarray, size: int) -> np.ndarray:
    """The stable order of numbers from 0 to size - 1; numbers of two bytes are sorted by digits, which is faster."""
    return np.argsort(x.astype(np.uint16) if size <= 1 << 16 else x, kind="stable")


class Rows:
    """Rows of a table in groups of equal ones, for sums over them. at: the distinct ones, those of long groups (over 8) first, then by falling length."""

    def __init__(self, rows: np.ndarray, size: int):
        self.order = sorted_order(rows, size)
        rows = rows.take(self.order)
        begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        length = np.diff(np.append(begin, len(rows)))
        falling = sorted_order(9 - np.minimum(length, 9), 9)
        self.begin, self.length = begin.take(falling), length.take(falling)
        self.at = rows.take(self.begin)
        #: how many groups have more than j members
        self.more = np.cumsum(np.bincount(np.minimum(length, 9), minlength=10)[::-1])[::-1][1:].tolist()

    def sums(self, grad: np.ndarray) -> np.ndarray:
        """The sum of grad over each group. Long ones are summed each, the others by their first, second, ... members at once."""
        order, begin, long = self.order, self.begin, self.more[8]
        out = grad.take(order.take(begin), axis=0)
        for j in range(1, 8):
            n = self.more[j]
            if n == long:
                break
            out[long:n] += grad.take(order.take(begin[long:n] + j), axis=0)
        if long:
            length = self.length[:long]
            rows = grad.take(order.take(X.runs_gather(begin[:long], length)), axis=0)
            ends = np.cumsum(length)
            for i, (x, y) in enumerate(zip((ends - length).tolist(), ends.tolist())):
                np.add.reduce(rows[x:y], 0, out=out[i : i + 1] if rows.ndim == 1 else out[i], keepdims=rows.ndim == 1)
        return out


#: Parameters with a row for each word: context vectors, target vectors, biases.
_BY_WORD = (0, 3, 4)


class Trainer:
    """NCE with Adagrad on one task's tokens."""

    def __init__(self, v: Vocabulary, o: LmOptions, seed: int):
        self.v, self.o, self.rng = v, o, np.random.default_rng(seed)
        self.p = begin(v, o)
        mass = class_mass(v)
        # a gradient is a sum over a batch: what is often in it begins with as much damping as it will have
        word = o.batch * v.counts / max(1, v.n)
        often = [np.concatenate([word, np.full(o.tail + 1, 1.0)]), np.full(o.dims, 0.05 * o.batch), np.full(o.dims, 0.05 * o.batch), word, word, o.batch * mass, o.batch * mass]
        self.g2 = [(np.zeros_like(a) + (0.1 * (1 + n * n)).reshape(-1, *[1] * (a.ndim - 1))).astype(np.float32) for a, n in zip(self.p, often)]
        self.edges = np.cumsum(mass)
        self.log_kp = np.log(o.noise_per_token * mass).astype(np.float32)
        self.size_of = np.append(np.diff(v.begin), 0)
        self.class_of = np.append(v.class_of(), v.classes).astype(np.int32)
        more = v.counts + 1
        self.word_edges = np.concatenate([[0.0], np.cumsum(more)])
        within = np.add.reduceat(more, v.begin[:-1]) if len(more) else np.zeros(0)
        self.word_kp = np.log(o.noise_per_token * more / np.repeat(within, np.diff(v.begin))).astype(np.float32)
        self.seen = 0
        self.met = [np.zeros(len(self.p[i]), np.int64) for i in _BY_WORD]

    def _step(self, i: int, grad: np.ndarray, rows: Rows | None = None) -> None:
        rate = self.o.bias_rate if self.p[i].ndim == 1 else self.o.rate
        if rows is None:
            self.g2[i] += grad * grad
            self.p[i] -= rate * grad / np.sqrt(self.g2[i])
            return
        grad, rows = rows.sums(grad), rows.at
        g2 = self.g2[i].take(rows, axis=0)
        g2 += grad * grad
        self.g2[i][rows] = g2
        np.sqrt(g2, out=g2)
        grad /= g2
        grad *= rate
        self.p[i][rows] = self.p[i].take(rows, axis=0) - grad

    def learn(self, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> None:
        """One step on the tokens w (numbers, -1: rare) after the contexts one and two."""
        r, c1, c2, q, b, u, a = self.p
        o, k = self.o, self.v.classes
        cls = self.class_of[w]  # -1 takes the last: the rare class
        order = sorted_order(cls, k + 1)
        w, cls = w[order], cls[order]
        both = np.concatenate([one[order], two[order]])
        x = r.take(both, axis=0)
        x1, x2 = x[: len(w)], x[len(w) :]
        h = x1 @ c1
        h += x2 @ c2
        # classes
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(o.noise)), k)
        uc, un = u.take(cls, axis=0), u[noise]
        dp = sigmoid((self.log_kp - a)[cls] - np.einsum("ij,ij->i", h, uc)) - np.float32(1)
        dn = h @ -un.T
        dn += self.log_kp[noise] - a[noise]
        dn = sigmoid(dn, o.noise_per_token / o.noise)
        dh = dn @ un
        uc *= dp[:, None]
        dh += uc
        at = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        gu, ga = np.zeros_like(u), np.zeros_like(a)
        gu[cls[at]], ga[cls[at]] = np.add.reduceat(dp[:, None] * h, at, axis=0), np.add.reduceat(dp, at)
        np.add.at(gu, noise, dn.T @ h)
        np.add.at(ga, noise, dn.sum(0))
        # words within classes of two or more: the tokens of a class stand together, so each class is a slice
        have, ends = cls[at], np.append(at[1:], len(cls))
        many = (have < k) & (self.size_of[have] > 1)
        have, begins, ends = have[many], at[many], ends[many]
        if len(have):
            low, top = self.word_edges[self.v.begin[have]], self.word_edges[self.v.begin[have + 1]]
            drawn = np.searchsorted(self.word_edges, low[:, None] + self.rng.random((k, o.word_noise))[have] * (top - low)[:, None], "right") - 1
            drawn = np.minimum(drawn, self.v.begin[have + 1, None] - 1)
            tokens = X.runs_gather(begins, ends - begins)
            q_drawn, known, hk = q.take(drawn, axis=0), w[tokens], h.take(tokens, axis=0)
            # a class's tokens are cut into pieces of _PIECE, filled up with zeros, so that one product takes all pieces
            count = ends - begins
            pieces = -(-count // _PIECE)
            piece_of = np.repeat(np.cumsum(pieces) - pieces, count) * _PIECE + X.runs_gather(np.zeros_like(count), count)
            which = np.repeat(np.arange(len(have)), pieces)
            drawn, q_drawn = drawn[which], q_drawn[which]
            filled = np.zeros((len(which) * _PIECE, o.dims), np.float32)
            filled[piece_of] = hk
            filled = filled.reshape(-1, _PIECE, o.dims)
            d = np.matmul(filled, -q_drawn.transpose(0, 2, 1))
            d += (self.word_kp[drawn] - b[drawn])[:, None, :]
            d = sigmoid(d, o.noise_per_token / o.word_noise)
            there = np.zeros(len(which) * _PIECE, np.float32)
            there[piece_of] = 1
            d *= there.reshape(-1, _PIECE, 1)
            qw = q.take(known, axis=0)
            dw = sigmoid((self.word_kp - b)[known] - np.einsum("ij,ij->i", hk, qw)) - np.float32(1)
            qw *= dw[:, None]
            qw += np.matmul(d, q_drawn).reshape(-1, o.dims).take(piece_of, axis=0)
            grads = np.empty((len(known) + drawn.size, o.dims), np.float32)
            np.multiply(hk, dw[:, None], out=grads[: len(known)])
            np.matmul(d.transpose(0, 2, 1), filled, out=grads[len(known) :].reshape(len(which), o.word_noise, o.dims))
            dh[tokens] = dh.take(tokens, axis=0) + qw
            rows = Rows(np.concatenate([known, drawn.ravel()]), len(q))
            self._step(3, grads, rows)
            self._step(4, np.concatenate([dw, d.sum(1).ravel()]), rows)
        self._step(5, gu)
        self._step(6, ga)
        self._step(0, np.concatenate([dh @ c1.T, dh @ c2.T]), Rows(both, len(r)))
        self._step(1, x1.T @ dh)
        self._step(2, x2.T @ dh)
        self.met[0] += np.bincount(both, minlength=len(r))
        self.met[1] += np.bincount(w[w >= 0], minlength=len(q))
        self.seen += len(w)


def summed(row: np.ndarray, n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of n and x over equal neighbours in row."""
    at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return row[at], np.add.reduceat(n, at), np.add.reduceat(x, at, axis=0)


def train(docs: DataFrame, v: Vocabulary, o: LmOptions) -> list[np.ndarray]:
    """The averaged parameters after one pass of every trainer over its documents (text)."""
    trainers = max(1, math.ceil(v.n / o.trainer_tokens))
    shared = docs.sparkSession.sparkContext.broadcast(v)
    first = begin(v, o)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Trainer(shared.value, o, o.seed + TaskContext.get().partitionId())
        for batch in batches:
            for s in X.slices(batch.column("text")):
                h, before = tokens(s)
                _, _, own, one, two = numbers(t.v, h, before, o)
                order = t.rng.permutation(len(own))
                for lo in range(0, len(own), o.batch):
                    i = order[lo : lo + o.batch]
                    t.learn(one[i], two[i], own[i])
        if t.seen:
            t.met[2] = t.met[1]
            for i, x in enumerate(t.p):
                x = x.reshape(len(x), -1) if i in _BY_WORD else x.reshape(1, -1)
                weight = t.met[_BY_WORD.index(i)] if i in _BY_WORD else np.array([t.seen])
                at = np.flatnonzero(weight)
                for lo in range(0, len(at), 4096):
                    some = at[lo : lo + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int32)), pa.array(weight[some].astype(np.float64)), pa.array([y.tobytes() for y in x[some]], pa.binary())], names=["i", "row", "n", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of (i, row); the weighted sums of each, then their means."""
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            which, row, n = (np.asarray(batch.column(c)) for c in ("i", "row", "n"))
            for i in np.unique(which).tolist():
                at = np.flatnonzero(which == i)
                x = np.frombuffer(b"".join(batch.column("x").take(pa.array(at)).to_pylist()), np.float32).reshape(len(at), -1)
                held.setdefault(i, []).append(summed(row[at], n[at], x * n[at][:, None]))
        for i, parts in held.items():
            row, n, x = summed(*(np.concatenate(z) for z in zip(*parts)))
            x = (x / n[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), i, np.int32)), pa.array(row), pa.array(n), pa.array([y.tobytes() for y in x], pa.binary())], names=["i", "row", "n", "x"])

    schema = "i int, row int, n double, x binary"
    got = docs.select("text").repartition(trainers).mapInArrow(run, schema).repartition("i", "row").sortWithinPartitions("i", "row", "n", "x").mapInArrow(add, schema).toArrow()
    out = [a.copy() for a in first]  # words that no task has met stay as they were
    which, row = np.asarray(got["i"]), np.asarray(got["row"])
    for i, a in enumerate(out):
        at = np.flatnonzero(which == i)
        if len(at):
            x = np.frombuffer(b"".join(got["x"].take(pa.array(at)).to_pylist()), np.float32)
            if i in _BY_WORD:
                a[row[at]] = x.reshape(len(at), *a.shape[1:])
            else:
                a[...] = x.reshape(a.shape)
    return out


@dataclass
class Scorer:
    """The vocabulary, the two context tables r C1 and r C2, and q, b, u, a."""

    v: Vocabulary
    r1: np.ndarray
    r2: np.ndarray
    q: np.ndarray
    b: np.ndarray
    u: np.ndarray
    a: np.ndarray

    def __post_init__(self) -> None:
        # biases as one more column
        self.u1, self.q1 = (np.concatenate([m, bias[:, None]], 1) for m, bias in ((self.u, self.a), (self.q, self.b)))

    def log_probability(self, one: np.ndarray, two: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural logarithms of P(w | one, two); for rare tokens (w = -1) of P(rare | one, two)."""
        k, begin = self.v.classes, self.v.begin
        cls = np.where(w >= 0, self.v.class_of()[w] if k else 0, k)
        order = sorted_order(cls, k + 1)
        cls, own = cls[order], w[order]
        out = np.empty(len(w))
        for lo in range(0, len(w), _BLOCK):  # so that the scores of a block stay small
            i = order[lo : lo + _BLOCK]
            h, c = np.ones((len(i), self.u1.shape[1]), np.float32), cls[lo : lo + _BLOCK]
            np.add(self.r1.take(one[i], axis=0), self.r2.take(two[i], axis=0), out=h[:, :-1])
            lp = _log_softmax(h, self.u1, c)
            at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])).tolist()
            for x, y in zip(at, [*at[1:], len(c)]):
                g = int(c[x])
                if g < k and begin[g + 1] - begin[g] > 1:
                    lp[x:y] += _log_softmax(h[x:y], self.q1[begin[g] : begin[g + 1]], own[lo + x : lo + y] - begin[g])
            out[i] = lp
        return out


def _log_softmax(h: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of the normalised scores h . m at one place in each row, some rows at a time. The last columns are one (h) and the bias (m)."""
    own = np.einsum("ij,ij->i", h, m.take(at, axis=0)).astype(np.float64)
    # a bound on all scores: where it is small nothing need be taken off before exp
    x, y = h[:, :-1], m[:, :-1]
    most = np.sqrt(np.einsum("ij,ij->i", x, x).max() * np.einsum("ij,ij->i", y, y).max()) + np.abs(m[:, -1]).max()
    total = np.empty(len(h), np.float32)
    ones = np.ones(len(m), np.float32)
    rows = max(64, (1 << 17) // len(m))
    held = np.empty((min(rows, len(h)), len(m)), np.float32)
    for lo in range(0, len(h), rows):
        s = np.matmul(h[lo : lo + rows], m.T, out=held[: len(h) - lo])
        if most > 60:
            top = s.max(1)
            s -= top[:, None]
            own[lo : lo + rows] -= top
        np.exp(s, out=s)
        np.matmul(s, ones, out=total[lo : lo + rows])
    return own - np.log(total.astype(np.float64))


def scorer(v: Vocabulary, p: list[np.ndarray]) -> Scorer:
    r, c1, c2, q, b, u, a = p
    return Scorer(v, r @ c1, r @ c2, q, b, u, a)


def score_hot(docs: DataFrame, m: Scorer, o: LmOptions) -> DataFrame:
    """A written table: rid, doc_id, held_out and the sums over the hot words; others: the hashes of the words that are not hot."""
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        v = model.v
        rid = TaskContext.get().partitionId() << 40
        lift = np.log10(v.c + 1.0)
        for batch in batches:
            for s in X.slices(batch.column("text")):
                h, before = tokens(s)
                at, hot, word, one, two = numbers(v, h, before, o)
                lp = model.log_probability(one, two, word) / np.log(10)
                own = np.where(hot, lift[at] if len(lift) else 0.0, 0.0)

                def total(x: np.ndarray) -> np.ndarray:
                    c = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
                    return c[before[1:]] - c[before[:-1]]

                cold = np.concatenate([[0], np.cumsum(~hot)])[before].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid + np.arange(s.docs, dtype=np.int64)), batch.column("doc_id").slice(s.lo, s.docs), batch.column("held_out").slice(s.lo, s.docs), pa.array(np.diff(before).astype(np.int64)), pa.array(total(hot.astype(np.int64))), pa.array(total(own)), pa.array(total(lp)), pa.array(total(np.where(word < 0, own, 0.0))), pa.array(total((word < 0).astype(np.int64))), pa.ListArray.from_arrays(pa.array(cold), pa.array(X.signed(h[~hot])))],
                    names=["rid", "doc_id", "held_out", "n_tokens", "n_hot", "base_hot", "class_score", "rare_hot", "n_rare", "others"],
                )
                rid += s.docs

    schema = "rid long, doc_id long, held_out boolean, n_tokens long, n_hot long, base_hot double, class_score double, rare_hot double, n_rare long, others array<long>"
    return cut(docs.mapInArrow(run, schema), "scored")


def lm_scores(docs: DataFrame, options: LmOptions = LmOptions()) -> DataFrame:
    """docs: doc_id, text, held_out (boolean), train (boolean). Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    learn = docs.filter("train").select("text")
    table = counts(learn)
    v = vocabulary(table, options)
    m = scorer(v, train(learn, v, options))
    rows = score_hot(docs.select("doc_id", "text", "held_out"), m, options)
    cold = rows.select("rid", F.explode("others").alias("h")).join(table.filter(F.col("c") < v.least), "h")
    cold = cold.groupBy("rid").agg(F.count(F.lit(1)).alias("n_cold"), F.sum(F.log10(F.col("c") + F.lit(1.0))).alias("cold"))
    out = rows.drop("others").join(cold, "rid", "left")
    lift = F.coalesce("cold", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_hot") + F.coalesce("n_cold", F.lit(0))).alias("n_known"),
        F.lit(v.n).cast("long").alias("train_tokens"),
        (F.col("base_hot") + lift - F.col("n_tokens") * float(np.log10(v.n + v.v + 1.0))).alias("base_score"),
        (F.col("class_score") + F.col("rare_hot") + lift - F.col("n_rare") * float(np.log10(v.rare_total))).alias("score"),
    )
