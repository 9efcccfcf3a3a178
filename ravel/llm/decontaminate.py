"""Benchmark decontamination: hashed windows of the benchmark's words are broadcast and looked up along every document.

Words: A-Z lower-cased, then runs outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. A window is `n` consecutive words of an item; an
item of fewer words, but not none, is one window. A hash hit is verified word by word before it counts.

The broadcast table is three sorted arrays (24 bytes a window) over the items' words in one byte buffer: at most `BUILT` bytes for a
byte of benchmark text. It is taken if that bound is within `table_bytes`. A larger benchmark stays a distributed table: a bit filter of bounded size over its
hashes is broadcast instead, and the windows of documents that pass it meet the table in a join on length, hash and words. Both ways verify every hit and
give the same result; no broadcast grows beyond its bound.

Defined cases: null and empty texts have no words and no hits; very long texts are scanned whole; items without words (or null) have no windows; item ids that
repeat count once in n_items; repeated documents are judged each; an empty benchmark hits nothing, an empty table stays empty. Items with a null id are left out,
unless `unnamed` is set, as the query and the pipeline do: then their windows count in n_hit and in the spans, as in ORACLE, and only `items` is without them. Other
columns pass through whatever their names; if one has the result's name, ValueError says so (remove_documents and remove_spans find a free name by themselves).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravel.llm import textcore as X
from ravel.llm.common import Bits, annotate, bits_of, cut, free_name, fresh


@dataclass(frozen=True)
class DecontaminationOptions:
    n: int = 10
    #: Bytes of the broadcast table at most.
    table_bytes: int = 64 << 20
    unnamed: bool = False


HIT = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
#: hits: word ranges [start, end) of the verified windows; span_from and span_to: byte ranges of the union of the hits.
FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("span_from", T.ArrayType(T.LongType())), T.StructField("span_to", T.ArrayType(T.LongType()))])


#: Bytes of the table for a byte of text at most: a window of 24 bytes for every second byte, the words, and two bits in a filter for each bit of it.
BUILT = 16


class Windows:
    """The windows of items, by length: sorted hashes, where the words stand in one buffer, and the item's number (-1: without id)."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.names = sorted({str(i) for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.names)}
        ids = np.array([-1 if i is None else number[str(i)] for i, _ in items], np.int32)
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, Bits]] = {}
        parts, made, size = [], [], 0
        for s in X.slices(pa.array([t for _, t in items], pa.large_string())):
            buffer, row, k, h, at, end = windows(s, n)
            parts.append(buffer)
            made.append((k, h, at + size, (end - at).astype(np.int32), ids[s.lo + row]))
            size += len(buffer)
        self.buffer = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        if not made:
            return
        k, h, at, length, item = (np.concatenate(c) for c in zip(*made))
        for size in np.unique(k).tolist():
            own = np.flatnonzero(k == size)
            own = own[np.lexsort((item[own], h[own]))]
            # an item's equal windows once (equal hashes with other words stay)
            own = own[[i == 0 or (h[own[i]], item[own[i]]) != (h[own[i - 1]], item[own[i - 1]]) or self._text(at, length, own[i]) != self._text(at, length, own[i - 1]) for i in range(len(own))]]
            self.by[size] = (h[own], at[own], length[own], item[own], Bits.of(h[own]))

    def _text(self, at: np.ndarray, length: np.ndarray, i: int) -> bytes:
        return self.buffer[at[i] : at[i] + length[i]].tobytes()

    def nbytes(self) -> int:
        return self.buffer.nbytes + sum(h.nbytes + at.nbytes + length.nbytes + item.nbytes + bits.words.nbytes for h, at, length, item, bits in self.by.values())

    def of(self, size: int, key: int, text: bytes) -> list[int] | None:
        """The items (without those that have no id) with a window, None if there is none."""
        h, at, length, item, _ = self.by[size]
        lo, hi = np.searchsorted(h, np.uint64(key)), np.searchsorted(h, np.uint64(key), "right")
        found = [int(item[i]) for i in range(lo, hi) if self._text(at, length, i) == text]
        return [i for i in found if i >= 0] if found else None


def windows(s: X.Slice, n: int):
    """The words of a slice in one buffer, a space after each; and of every window its document, length in words, hash, and begin and end in the buffer."""
    data, starts, ends, before, h = words(s)
    size = ends - starts
    buffer = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    at = np.cumsum(size + 1) - size - 1
    buffer[X.runs_gather(at, size)] = data[X.runs_gather(starts, size)]
    count = np.diff(before)
    out = []
    for k in np.unique(np.minimum(count, n)).tolist():
        docs = np.flatnonzero(np.minimum(count, n) == k)
        if k:
            first = X.runs_gather(before[docs], count[docs] - k + 1)
            out.append((np.repeat(docs, count[docs] - k + 1), np.full(len(first), k), X.windows_hash(h, k)[first], at[first], at[first + k - 1] + size[first + k - 1]))
    if not out:
        zero = np.zeros(0, np.int64)
        return buffer, zero, zero, np.zeros(0, np.uint64), zero, zero
    return buffer, *(np.concatenate(c) for c in zip(*out))


def words(s: X.Slice):
    data = X.LOWER[s.data]
    starts, ends, before = s.words(X.ALNUM[data])
    return data, starts, ends, before, s.spans_hash(s.prefix(data), starts, ends)


def candidates(s: X.Slice, filters: dict[int, Bits]) -> tuple[np.ndarray, list[tuple[int, int, int, int, int, int, bytes]]]:
    """The number of words of each document of a slice; and of every window whose hash passes the filter of its length: document, first word, length, begin
    and end in the document's bytes, hash, words."""
    data, starts, ends, before, h = words(s)
    doc = np.repeat(np.arange(s.docs), np.diff(before))
    out = []
    for k, bits in filters.items():
        run = X.windows_hash(h, k)
        at = np.flatnonzero(bits.may_have(X.signed(run)))
        at = at[doc[at] == doc[at + k - 1]]
        for i in at.tolist():
            d = int(doc[i])
            out.append((d, i - int(before[d]), k, int(starts[i] - s.off[d]), int(ends[i + k - 1] - s.off[d]), int(run[i]), b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(i, i + k))))
    return np.diff(before), out


def union(hits: list[tuple[int, int, int, int]]) -> tuple[int, list[int], list[int]]:
    """Words in the union of (first word, length, begin, end), and the byte ranges of its runs of words."""
    out: list[list[int]] = []
    for i, k, a, b in sorted(set(hits)):
        if out and i <= out[-1][1]:
            if i + k > out[-1][1]:
                out[-1][1], out[-1][3] = i + k, b
        else:
            out.append([i, i + k, a, b])
    return sum(x[1] - x[0] for x in out), [x[2] for x in out], [x[3] for x in out]


def _result(n_words: list[int], hits: list[list[tuple[int, int, int, int]]], items: list[list[str]]) -> list[pa.Array]:
    """The fields of FIELDS."""
    spans = [union(h) for h in hits]
    return [pa.array(n_words, pa.int64()), pa.array([x[0] for x in spans], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([x[1] for x in spans], pa.list_(pa.int64())), pa.array([x[2] for x in spans], pa.list_(pa.int64()))]


def find(docs: DataFrame, benchmark: DataFrame, options: DecontaminationOptions = DecontaminationOptions(), name: str = "decontamination", drop_text: bool = False) -> DataFrame:
    """docs with the struct column `name` of FIELDS."""
    free_name(docs, name)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    items = items if options.unnamed else items.filter("item_id is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size * BUILT > options.table_bytes:
        return _join(docs, items, options, name, drop_text)
    rows = items.toArrow()  # table_bytes / BUILT bytes of text at most
    shared = docs.sparkSession.sparkContext.broadcast(Windows(list(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist())), options.n))

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        table = shared.value
        n_words, hits, found = [], [], []
        for s in X.slices(batch.column("text")):
            n, some = candidates(s, {k: v[4] for k, v in table.by.items()})
            n_words += n.tolist()
            own: list[list] = [[] for _ in range(s.docs)]
            names: list[set[int]] = [set() for _ in range(s.docs)]
            for d, i, k, a, b, key, text in some:
                got = table.of(k, key, text)
                if got is not None:
                    own[d].append((i, k, a, b))
                    names[d].update(got)
            hits += own
            found += [sorted(table.names[i] for i in x) for x in names]
        return _result(n_words, hits, found)

    return annotate(docs, name, FIELDS, work, drop_text=drop_text)


def _join(docs: DataFrame, items: DataFrame, o: DecontaminationOptions, name: str, drop_text: bool) -> DataFrame:
    """`find` for a benchmark of any size."""
    spark = docs.sparkSession

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            for s in X.slices(batch.column("text")):
                buffer, row, k, h, at, end = windows(s, o.n)
                raw = buffer.tobytes()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(s.lo + row)), pa.array(k.astype(np.int32)), pa.array(X.signed(h)), pa.array([raw[x:y] for x, y in zip(at.tolist(), end.tolist())], pa.binary())], names=["item_id", "k", "h", "t"])

    table = items.mapInArrow(make, "item_id string, k int, h long, t binary").groupBy("k", "h", "t").agg(F.collect_set("item_id").alias("items"))
    table = cut(table, "windows")
    bits = {int(r[0]): bits_of(table.filter(F.col("k") == r[0]), "h") for r in table.select("k").distinct().collect()}  # o.n lengths at most
    shared = spark.sparkContext.broadcast(bits)
    fields = T.StructType([T.StructField("rid", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("some", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in "ikabh"] + [T.StructField("t", T.BinaryType())])))])
    count: dict[int, int] = {}

    def scan(batch: pa.RecordBatch) -> list[pa.Array]:
        part = TaskContext.get().partitionId()
        first = count.get(part, 0)
        count[part] = first + batch.num_rows
        n_words, some = [], []
        for s in X.slices(batch.column("text")):
            n, got = candidates(s, shared.value)
            n_words += n.tolist()
            own: list[list] = [[] for _ in range(s.docs)]
            for d, i, k, a, b, key, text in got:
                own[d].append({"i": i, "k": k, "a": a, "b": b, "h": key - (1 << 64) if key >> 63 else key, "t": text})
            some += own
        kind = pa.list_(pa.struct([*((c, pa.int64()) for c in "ikabh"), ("t", pa.binary())]))
        return [pa.array((part << 40) + first + np.arange(batch.num_rows, dtype=np.int64)), pa.array(n_words, pa.int64()), pa.array(some, kind)]

    scanned = cut(annotate(docs, name, fields, scan, drop_text=drop_text), "scanned")
    met = scanned.select(F.col(f"{name}.rid").alias("rid"), F.explode(f"{name}.some").alias("c")).select("rid", "c.*").join(table, ["k", "h", "t"])
    found = met.groupBy("rid").agg(F.collect_set(F.struct("i", "k", "a", "b")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    rid, hits, names = (fresh([*scanned.columns, name], c) for c in ("rid", "hits", "items"))
    found = found.select(F.col("rid").alias(rid), F.col("hits").alias(hits), F.col("items").alias(names))
    none = F.array().cast("array<string>")
    back = scanned.join(found, F.col(f"{name}.rid") == F.col(rid), "left").withColumn(names, F.coalesce(F.col(names), none))
    other = fresh(back.columns, f"{name}_")

    def finish(batch: pa.RecordBatch) -> list[pa.Array]:
        n_words = [x["n_words"] for x in batch.column(name).to_pylist()]
        return _result(n_words, [[(h["i"], h["k"], h["a"], h["b"]) for h in x or []] for x in batch.column(hits).to_pylist()], batch.column(names).to_pylist())

    return annotate(back, other, FIELDS, finish).drop(name, rid, hits, names).withColumnRenamed(other, name)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def remove_documents(docs: DataFrame, benchmark: DataFrame, options: DecontaminationOptions = DecontaminationOptions()) -> DataFrame:
    """The documents without a verified hit, with their own columns."""
    name = fresh(docs.columns, "decontamination")
    return find(docs, benchmark, options, name).filter(F.col(f"{name}.n_hit") == 0).drop(name)


def remove_spans(docs: DataFrame, benchmark: DataFrame, options: DecontaminationOptions = DecontaminationOptions()) -> DataFrame:
    """All documents, the bytes from the first to the last word of each hit span taken out of their texts."""
    name = fresh(docs.columns, "decontamination")
    rest = F.col(name)
    keep = F.transform(F.sequence(F.lit(0), F.size(rest["span_from"])), lambda i: F.struct(F.when(i > 0, rest["span_to"][i - 1]).otherwise(F.lit(0)).alias("a"), F.when(i < F.size(rest["span_from"]), rest["span_from"][i]).otherwise(F.octet_length("text").cast("long")).alias("b")))
    raw = F.encode("text", "UTF-8")
    parts = F.transform(keep, lambda k: F.decode(F.substring(raw, (k["a"] + 1).cast("int"), (k["b"] - k["a"]).cast("int")), "UTF-8"))
    return find(docs, benchmark, options, name).withColumn("text", F.when(F.size(rest["span_from"]) > 0, F.array_join(parts, "")).otherwise(F.col("text"))).drop(name)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT p.doc_id, p.i, p.k, g.item_id FROM p JOIN g ON p.k = g.k AND p.g = g.g),
hw AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS w FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
