"""Quality rules: the log-likelihood ratio of hashed byte n-grams between a trusted target and the raw corpus.

Two multinomials over `buckets` hashed byte n-grams are counted over all documents: q over the whole raw corpus, p over the
documents that a label marks as trusted. A document's verdict is the mean over its n-grams of log p(h)/q(h), against a fixed
threshold, so every document gets the same answer whatever partition it is in.

Counting reads the texts where they are. The trusted doc_ids make a bit filter of bounded size, the doc_ids that pass it without being trusted (found by a
join of ids alone) a second one: a document that passes the first and not the second is trusted, one that doesn't pass the first is not. Only the texts that
pass both, a few in a hundred while the filters aren't full, meet the trusted ids in a join. Sums per task come before the shuffle; what reaches the driver is one
number pair per bucket, at any input size.

Defined cases: a null or empty text has no words and no n-grams, its ratio is 0 and it fails the base rules; a very long text is judged whole, in one task's
memory; repeated rows are counted and judged as often as they come; a doc_id with several labels is trusted if any of them is 1, a null doc_id never is; with no
trusted document at all, or an empty table, the ratio is 0 everywhere; a ratio equal to the threshold is kept. Extra columns pass through; if one has the
result's name, ValueError says so (keep_good finds a free name by itself).
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
from ravel.llm.common import annotate, bits_of, cut, free_name, fresh, marked_by, text_and_id


@dataclass(frozen=True)
class QualityOptions:
    n: int = 4
    buckets: int = 1 << 16
    alpha: float = 1.0
    #: The least mean log ratio (natural logarithm) of a kept document.
    threshold: float = -0.5
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    #: Bits of the filters of doc_ids at most.
    filter_bits: int = 1 << 26


FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("llr", T.DoubleType()), T.StructField("kept", T.BooleanType())])

_SYMBOLS = X.table(lambda b: chr(b) in "#*$%&|<>")


def grams(s: X.Slice, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each byte n-gram that lies within one document, and how many of them begin before each document (one more at the end)."""
    size = len(s.data)
    m = max(0, size - n + 1)
    key = np.zeros(m, np.uint64)
    for k in range(n):
        key = (key << np.uint64(8)) | s.data[k : k + m]
    whole = np.ones(m + 1, bool)
    for k in range(1, n):  # windows that reach over a document's end
        at = s.off[1:-1] - k
        whole[at[(at >= 0) & (at < m)]] = False
    whole = whole[:m]
    bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(buckets - 1)
    before = np.concatenate([[0], np.cumsum(whole)])
    return bucket[whole].astype(np.int64), before[np.minimum(s.off, m)]


def gram_counts(docs: DataFrame, trusted: DataFrame, options: QualityOptions) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in all documents (doc_id, text) and in those whose doc_id is in trusted (distinct doc_ids, none null)."""
    sc = docs.sparkSession.sparkContext
    may = bits_of(trusted, "doc_id", options.filter_bits)
    ids = docs.select("doc_id").filter("doc_id is not null")
    wrong = ids.filter(marked_by(may, F.col("doc_id"), docs.sparkSession)).join(trusted, "doc_id", "left_anti").distinct()
    not_ = bits_of(cut(wrong, "untrusted"), "doc_id", options.filter_bits)
    known = docs.filter("doc_id is not null")
    unsure = known.filter(marked_by(may, F.col("doc_id"), docs.sparkSession) & marked_by(not_, F.col("doc_id"), docs.sparkSession)).join(trusted.hint("merge"), "doc_id", "left_semi")
    shared = sc.broadcast((may, not_))

    def count(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, options.buckets), np.int64)
        for batch in batches:
            if every:
                may, not_ = shared.value
                own_ids = batch.column("doc_id")
                key = np.asarray(own_ids.fill_null(0))
                mark = may.may_have(key) & ~not_.may_have(key) & np.asarray(own_ids.is_valid())
            else:
                mark = np.ones(batch.num_rows, bool)
            for s in X.slices(batch.column("text")):
                bucket, before = grams(s, options.n, options.buckets)
                if every:
                    total[0] += np.bincount(bucket, minlength=options.buckets)
                own = np.repeat(mark[s.lo : s.hi], np.diff(before))
                total[1] += np.bincount(bucket[own], minlength=options.buckets)
        at = np.flatnonzero(total.any(0))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "q", "p"])

    schema = "bucket long, q long, p long"
    rows = docs.select("doc_id", "text").mapInArrow(lambda b: count(b, True), schema).union(unsure.select("doc_id", "text").mapInArrow(lambda b: count(b, False), schema))
    got = rows.groupBy("bucket").agg(F.sum("q").alias("q"), F.sum("p").alias("p")).toArrow()  # one row a bucket at most
    out = np.zeros((2, options.buckets), np.int64)
    if got.num_rows:
        at = np.asarray(got["bucket"])
        out[0][at], out[1][at] = np.asarray(got["q"]), np.asarray(got["p"])
    return out[0], out[1]


def log_ratio(q: np.ndarray, p: np.ndarray, alpha: float) -> np.ndarray:
    if not p.sum():
        return np.zeros(len(q))
    return np.log((p + alpha) / (p.sum() + alpha * len(p))) - np.log((q + alpha) / (q.sum() + alpha * len(q)))


def base(s: X.Slice, window: int) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document of a slice."""
    inside = X.NOT_SPACE[s.data]
    starts, ends, before = s.words(inside)
    n_words = np.diff(before)
    chars = s.per_doc(inside & X.LEADS[s.data])
    symbols = s.per_doc(_SYMBOLS[s.data])
    prefix = s.prefix(s.data)
    salt = X.mix(np.arange(1, s.docs + 1, dtype=np.uint64))

    # lines: equal ones within a document have equal hashes after the document's salt
    l_starts, l_ends, l_before = s.words(s.data != 10)  # empty lines have no word anyway
    has = np.concatenate([[0], np.cumsum(inside)])
    l_doc = np.repeat(np.arange(s.docs), np.diff(l_before))
    worded = has[l_ends] > has[l_starts]
    h = s.spans_hash(prefix, l_starts[worded], l_ends[worded])
    dup = _repeats_per_doc(h ^ salt[l_doc[worded]], l_doc[worded], s.docs, first=False)

    w = s.spans_hash(prefix, starts, ends)
    doc = np.repeat(np.arange(s.docs), n_words)
    repeated = np.zeros(len(w) + 1, np.int64)
    if len(w) >= window:
        run = X.windows_hash(w, window)
        same = doc[window - 1 :] == doc[: len(run)]
        at = np.flatnonzero(same)
        key = run[at] ^ salt[doc[at]]
        order = np.argsort(key)
        k = key[order]
        eq = k[1:] == k[:-1]
        twice = np.zeros(len(k), bool)
        twice[1:] |= eq
        twice[:-1] |= eq
        hit = at[order[twice]]
        np.add.at(repeated, hit, 1)
        cover = np.cumsum(repeated)
        cover[window:] -= np.cumsum(repeated)[:-window]
        repeated = cover
    total = np.concatenate([[0], np.cumsum(repeated[: len(w)] > 0)])
    return [n_words, chars, symbols, dup, total[before[1:]] - total[before[:-1]]]


def _repeats_per_doc(key: np.ndarray, doc: np.ndarray, docs: int, first: bool) -> np.ndarray:
    order = np.argsort(key)
    k = key[order]
    again = np.concatenate([[False], k[1:] == k[:-1]]) if len(k) else np.zeros(0, bool)
    return np.bincount(doc[order[again]], minlength=docs)


def rules(docs: DataFrame, ratio: np.ndarray, options: QualityOptions, name: str, drop_text: bool = False) -> DataFrame:
    """Add the struct column `name` of FIELDS to documents."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        parts = []
        for s in X.slices(batch.column("text")):
            bucket, before = grams(s, options.n, options.buckets)
            score = np.concatenate([[0.0], np.cumsum(shared.value[bucket])])
            n = np.diff(before)
            parts.append([*base(s, options.window), (score[before[1:]] - score[before[:-1]]) / np.maximum(n, 1)])
        cols = [np.concatenate(c) for c in zip(*parts)]
        llr = np.round(cols[5], 9)
        failed = (cols[0] < options.min_words) | (100 * cols[4] > options.max_repeat_percent * cols[0])
        return [*(pa.array(c.astype(np.int64)) for c in cols[:5]), pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= options.threshold))]

    return annotate(docs, name, FIELDS, work, drop_text=drop_text)


def quality_rules(docs: DataFrame, trusted: DataFrame, options: QualityOptions = QualityOptions(), name: str = "quality_rules", drop_text: bool = False) -> DataFrame:
    """docs with the struct column `name`. trusted: doc_ids of the trusted documents (repeats and nulls do no harm)."""
    free_name(docs, name)
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    q, p = gram_counts(text_and_id(docs), cut(ids, "trusted"), options)
    return rules(docs, log_ratio(q, p, options.alpha), options, name, drop_text)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("quality") == 1).select("doc_id")


def keep_good(docs: DataFrame, labels: DataFrame, options: QualityOptions = QualityOptions()) -> DataFrame:
    """The documents that pass, with their own columns."""
    name = fresh(docs.columns, "quality_rules")
    return quality_rules(docs, trusted_ids(labels), options, name).filter(F.col(f"{name}.kept")).drop(name)
