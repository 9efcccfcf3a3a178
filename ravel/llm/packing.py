"""Best-fit packing by patterns: non-negative least squares over the histogram of lengths, then best fit for what is left.

1. Each document is encoded (its ids, then the end id) and cut: pieces of `size` ids, of which the first may be shorter. A piece knows its task
   and how many pieces of its length the task made before it. Pieces are a written table.
2. Their histogram (`size` counts at most) comes to the driver. Patterns of few lengths that fill a sequence are enumerated; non-negative
   least squares fits repeat counts to the histogram; rounded down and held within the counts they are filled, and the rest of the
   histogram is packed best fit, longest first. The plan is a list of patterns and repeat counts, as large for any input.
3. Every piece finds its sequence by its rank among the pieces of its length: ranks come from sums per task, not from a sort of a
   length's pieces, so one very frequent length is no bottleneck; the look-up is a search in the plan.

Defined cases: a null text is empty, an empty text is the end id alone; repeated rows are packed as often as they come; an empty table gives no
rows; the ids are those of the tokenizers library.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravel.llm import textcore as X
from ravel.llm.bpe import default_path, encoder
from ravel.llm.common import cut


@dataclass(frozen=True)
class PackOptions:
    size: int = 1024
    end: int = 2
    #: Most patterns with one length as their longest.
    patterns_per_length: int = 8
    rounds: int = 400


def pieces(docs: DataFrame, path: str, o: PackOptions) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, nth: the pieces of docs (doc_id, text), as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        part = TaskContext.get().partitionId()
        made = np.zeros(o.size + 1, np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            for s in X.slices(batch.column("text")):
                flat, at = enc.slice(s)
                n = np.diff(at) + 1
                count = -(-n // o.size)
                doc = np.repeat(np.arange(s.docs), count)
                piece = X.runs_gather(np.zeros(s.docs, np.int64), count)
                first = n - (count - 1) * o.size
                length = np.where(piece == 0, first[doc], o.size)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * o.size)
                # each document's ids with its end id, one after another
                whole = np.full(int(n.sum()), o.end, np.uint32)
                base = np.cumsum(n) - n
                whole[X.runs_gather(base, n - 1)] = flat
                raw = memoryview(whole.astype("<u4")).cast("B")
                a = (base[doc] + start) * 4
                crc = np.fromiter((zlib.crc32(raw[x:y]) for x, y in zip(a.tolist(), (a + length * 4).tolist())), np.int64, len(a))
                # how many of the same length came before, in this task
                order = np.argsort(length, kind="stable")
                sorted_length = length[order]
                begin = np.searchsorted(sorted_length, sorted_length)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - begin + made[sorted_length]
                made += np.bincount(length, minlength=o.size + 1)
                yield pa.RecordBatch.from_arrays([ids.slice(s.lo, s.docs).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(doc), part, np.int64)), pa.array(nth)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return cut(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"), "pieces")


def enumerate_patterns(hist: np.ndarray, size: int, per_length: int) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths that fill a sequence exactly; for each longest length those of the most frequent others."""
    have = np.flatnonzero(hist[:size])
    have = have[have > 0]
    out: dict[tuple[int, ...], None] = {}
    common = have[np.argsort(-hist[have], kind="stable")][:64]
    for a in have[::-1].tolist():
        rest = size - a
        if rest <= a and hist[rest] > 0:
            out[(a, rest)] = None
        found = []
        for b in common.tolist():
            c = rest - b
            if 0 < c <= b <= a and hist[c] > 0:
                found.append((min(hist[b], hist[c]), (a, b, c)))
            for d in common[:16].tolist():
                e = c - d
                if 0 < e <= d <= b <= a and hist[e] > 0:
                    found.append((min(hist[b], hist[d], hist[e]), (a, b, d, e)))
        found.sort(key=lambda x: (-x[0], x[1]))
        for _, p in found[:per_length]:
            out[p] = None
        # the longest lengths that still fit, one after another: patterns of long documents
        for b in have[(have <= min(a, rest))][::-1][: per_length].tolist():
            c = rest - b
            if 0 < c <= b and hist[c] > 0:
                out[(a, b, c)] = None
    return list(out)


def least_squares(patterns: list[tuple[int, ...]], hist: np.ndarray, rounds: int) -> np.ndarray:
    """Non-negative x with least |A x - hist|**2 (A: how often a pattern has a length), by accelerated projected gradients."""
    if not patterns:
        return np.zeros(0)
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.array([a for p in patterns for a in p])
    up = lambda x: np.bincount(row, x[col], len(hist))
    down = lambda r: np.bincount(col, r[row], len(patterns))
    v = np.ones(len(patterns))
    for _ in range(30):  # largest eigenvalue of A'A
        v = down(up(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - down(up(y) - hist) / (1.02 * top))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(hist: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts of lengths: patterns with repeat counts."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for a in range(size, 0, -1):
        left = int(hist[a])
        cap = a
        while left and cap <= size:
            if cap == size and not room[cap]:
                break
            while left and room[cap]:
                p, n = room[cap].pop()
                k = min(n, left)
                if n > k:
                    room[cap].append((p, n - k))
                room[cap - a].append(((*p, a), k))
                left -= k
            cap += 1
        if left:  # as many new sequences as are needed, each with as many of this length as fit
            each = size // a
            whole, more = divmod(left, each)
            if whole:
                room[size - each * a].append(((a,) * each, whole))
            if more:
                room[size - more * a].append(((a,) * more, 1))
    return [x for v in room.values() for x in v]


def plan(hist: np.ndarray, o: PackOptions) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that use up the histogram."""
    left = hist.astype(np.int64).copy()
    out = [((o.size,), int(left[o.size]))] if left[o.size] else []
    left[o.size] = 0
    patterns = enumerate_patterns(left, o.size, o.patterns_per_length)
    fitted = least_squares(patterns, left.astype(float), o.rounds)
    for i in np.argsort(-fitted, kind="stable").tolist():
        p, k = patterns[i], int(fitted[i] + 1e-6)
        for a in set(p):
            k = min(k, int(left[a]) // p.count(a))
        if k > 0:
            out.append((p, k))
            for a in p:
                left[a] -= k
    return out + sorted(best_fit(left, o.size), key=lambda x: x[0], reverse=True)


def places(made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ranks of a length from `key` (length * 2**44 + first rank) on: the first sequence and the offset there."""
    used: dict[int, int] = defaultdict(int)
    rows, seq = [], 0
    for p, k in made:
        off = 0
        for a in p:
            rows.append((a * (1 << 44) + used[a], seq, off))
            used[a] += k
            off += a
        seq += k
    rows.sort()
    r = np.array(rows, np.int64).reshape(-1, 3)
    return r[:, 0], r[:, 1], r[:, 2]


def pack(docs: DataFrame, path: str | None = None, options: PackOptions = PackOptions()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of docs (doc_id, text)."""
    table = pieces(docs, path or default_path(), options)
    each = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    by_part = each.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    hist = np.zeros(options.size + 1, np.int64)
    for length, n in each.groupBy("length").agg(F.sum("n")).collect():  # `size` rows at most
        hist[length] = n
    key, seq, off = places(plan(hist, options))
    shared = docs.sparkSession.sparkContext.broadcast((key, seq, off))
    ranked = table.join(by_part.select("part", "length", F.coalesce("before", F.lit(0)).alias("before")), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seqs, offs = shared.value
        for batch in batches:
            if batch.num_rows:
                k = np.asarray(batch.column("length")) * (1 << 44) + np.asarray(batch.column("rank"))
                at = np.searchsorted(keys, k, "right") - 1
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seqs[at] + k - keys[at]), pa.array(offs[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
