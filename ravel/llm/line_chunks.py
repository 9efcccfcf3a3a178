"""Line dedup with content-defined chunks of lines.

A text is split at \\n. Each line has a 32-bit value v (the first 8 hex digits of its md5). A rolling (Rabin-Karp) hash goes over the values of
the last `window` lines: r = v[i] + base * v[i-1] + base**2 * v[i-2] ... mod `prime`, lines before the text counting as 0. A chunk ends
after line i if r * divisor < prime, so a boundary depends on the last `window` lines and on nothing else, and a shared run of lines is cut at the
same places wherever it stands, but for the first window - 1 lines of it.
Two rules say what goes; both keep the first place (by doc_id, then the text's hash, then position) and remove the others:
1. chunks of `min_lines` lines or more that have a word;
2. passages: a shared run of lines may begin or end inside a chunk, or lie on one line. Each line with words, up to the next line with words, is a
   pair; neighbouring repeated pairs make a run, which goes if it has `run_words` words or more. A repeated line of `passage_words` words or more goes by itself.
   So two neighbouring common lines stay, unless they are a chunk or belong to a passage.
Each line that goes has an equal one at an earlier place; the first of all equal lines always stays.

Plan: the 64-bit hashes of all chunks, pairs and long lines are counted (partial sums first); those found twice go into a bit filter
of bounded size; what passes it is read again as a row of its line hashes, grouped by all of them, and the first place of each group found with
partial minima, so that a very frequent chunk is one row a task. Equality of bytes: each line of these rows is grouped by (hash, bytes); a hash with
two different lines is written into the rows with the lines' bytes in place of the hash, and the grouping is made again. What a document loses
is its rows without the first places; only documents that lose something meet those lists in a join, all others go straight through. No list of hashes
or documents comes to the driver.

Defined cases: a null text stays null, with 0 lines; an empty text is one empty line; rows with the same doc_id (null too) and the same text
are one document (they keep or lose the same lines); a chunk that repeats inside one document stays only at its first place; a document may become empty,
it stays as a row; a very long text is in one task's memory, its lines are never joined; an empty table gives an empty table. Other columns pass through whatever their
names; if one has the name of the result, ValueError says so (dedup_text finds a free name by itself).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravel.llm import textcore as X
from ravel.llm.common import Bits, annotate, bits_of, cut, free_name, fresh, marked_by, text_and_id


@dataclass(frozen=True)
class ChunkOptions:
    window: int = 3
    base: int = 31
    prime: int = 1_000_003
    divisor: int = 3
    min_lines: int = 2
    passage_words: int = 50
    run_words: int = 50
    #: Bits of a line's hash; the tests take few, so that different lines share one.
    hash_bits: int = 64


FIELDS = T.StructType([T.StructField("text", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("n_lines", "n_removed_lines", "n_removed_chunks", "n_removed_passages")])
CHUNK, PAIR, LONG = 0, 1, 2
U = np.uint64
_BASE = U(0xD6E8FEB86659FD93)


class Lines:
    """The lines of a slice of documents: begin and end bytes, document, words, value and hash; `before` counts those before each document."""

    def __init__(self, s: X.Slice, o: ChunkOptions):
        self.s, self.o = s, o
        at = np.flatnonzero(s.data == 10)
        doc = np.concatenate([np.arange(s.docs), np.searchsorted(s.off, at, "right") - 1])
        order = np.argsort(doc, kind="stable")  # a document's begin, then its newlines
        self.doc = doc[order]
        self.start = np.concatenate([s.off[:-1], at + 1])[order]
        self.before = np.searchsorted(self.doc, np.arange(s.docs + 1))
        self.end = np.empty(len(self.start), np.int64)
        self.end[:-1] = self.start[1:] - 1
        self.end[self.before[1:] - 1] = s.off[1:]
        words, _, _ = s.words(X.NOT_SPACE[s.data])
        self.words = np.searchsorted(words, self.end) - np.searchsorted(words, self.start)
        raw = memoryview(s.data.tobytes())
        md5 = hashlib.md5
        got = np.frombuffer(b"".join([md5(raw[a:b]).digest() for a, b in zip(self.start.tolist(), self.end.tolist())]), np.uint8).reshape(-1, 16)
        self.value = got[:, :4].copy().view(">u4").ravel().astype(np.int64)
        self.hash = got[:, 8:].copy().view("<u8").ravel() & U((1 << o.hash_bits) - 1)

    def chunk_begins(self) -> np.ndarray:
        """The first line of each chunk."""
        n, o = len(self.doc), self.o
        rolled = self.value.copy()
        for k in range(1, o.window):
            same = self.doc[k:] == self.doc[: n - k]
            rolled[k:] += self.value[: n - k] * same * (o.base**k % o.prime)
        ends = (rolled % o.prime) * o.divisor < o.prime
        begin = np.ones(n, bool)
        begin[1:] = ends[:-1] | (self.doc[1:] != self.doc[:-1])
        return np.flatnonzero(begin)

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kind, first line and the line after it of everything that may be removed."""
        o, n = self.o, len(self.doc)
        a = self.chunk_begins()
        b = np.append(a[1:], n)
        words = np.concatenate([[0], np.cumsum(self.words)])
        ok = (b - a >= o.min_lines) & (words[b] > words[a])
        worded = np.flatnonzero(self.words)
        pair = self.doc[worded[1:]] == self.doc[worded[:-1]]
        long = np.flatnonzero(self.words >= o.passage_words)
        first = np.concatenate([a[ok], worded[:-1][pair], long])
        after = np.concatenate([b[ok], worded[1:][pair] + 1, long + 1])
        return np.repeat([CHUNK, PAIR, LONG], [int(ok.sum()), int(pair.sum()), len(long)]), first, after

    def keys(self, kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each piece's kind and lines."""
        n = len(self.hash)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, U), np.cumsum(X.mix(self.hash) * X.powers(_BASE, n)[:n], dtype=U)])
            return X.mix((total[b] - total[a]) * X.powers(_BASE, n + 1, True)[a] + ((b - a) * 4 + kind).astype(U))

    def line(self, i: int) -> bytes:
        return self.s.data[self.start[i] : self.end[i]].tobytes()


def _counts(docs: DataFrame, o: ChunkOptions) -> DataFrame:
    """k: the hashes of pieces that stand at two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(lambda b: b.num_rows, batches):
            found = [m.keys(*m.pieces()) for m in (Lines(s, o) for s in X.slices(batch.column("text")))]
            k, n = X.sorted_counts(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([pa.array(X.signed(k)), pa.array(n.astype(np.int64))], names=["k", "n"])

    return cut(docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).filter("n > 1").select("k"), "repeats")


def _members(docs: DataFrame, again: Bits, clashes: Bits | None, o: ChunkOptions) -> DataFrame:
    """A written table. Rows with a code (4 * first line + kind): a piece that may stand elsewhere too, `key` its kind and the hashes (or, for hashes that clash,
    the bytes) of its lines. Rows without: a line (key) of such a piece, and its hash as h."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((again, clashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, clashes = shared.value
        seen: set[int] = set()
        for batch in batches:
            ids, hs = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()
            for s in X.slices(batch.column("text")):
                m = Lines(s, o)
                kind, a, b = m.pieces()
                want = again.may_have(X.signed(m.keys(kind, a, b)))
                kind, a, b = kind[want], a[want], b[want]
                if not len(a):
                    continue
                raw, odd = m.hash.astype("<u8").tobytes(), None
                if clashes is not None:
                    odd = np.concatenate([[0], np.cumsum(clashes.may_have(X.signed(m.hash)))])
                doc = m.doc[a]
                key = []
                for c, x, y in zip(kind.tolist(), a.tolist(), b.tolist()):
                    if odd is not None and odd[y] > odd[x]:
                        lines = [m.line(i) for i in range(x, y)]
                        key.append(bytes([c, 255]) + b"".join(len(t).to_bytes(8, "little") + t for t in lines))
                    else:
                        key.append(bytes([c]) + raw[8 * x : 8 * y])
                at = X.sorted_unique(X.runs_gather(a, b - a)).tolist()
                if len(seen) > 1 << 20:  # only spares the shuffle some lines
                    seen.clear()
                at = [i for i in at if clashes is None and (m.hash[i], m.end[i] - m.start[i]) not in seen and not seen.add((m.hash[i], m.end[i] - m.start[i]))]
                key += [m.line(i) for i in at]
                own = [ids[s.lo + i] for i in doc.tolist()]
                h = [hs[s.lo + i] for i in doc.tolist()] + X.signed(m.hash[at]).tolist()
                code = (a - m.before[doc]) * 4 + kind
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.binary()), pa.array(own + [None] * len(at), pa.int64()), pa.array(h, pa.int64()), pa.array(code.tolist() + [None] * len(at), pa.int64())],
                    names=["key", "doc_id", "h", "code"],
                )

    return cut(docs.mapInArrow(run, "key binary, doc_id long, h long, code long"), "chunks")


def removals(docs: DataFrame, o: ChunkOptions) -> DataFrame:
    """doc_id, h, cuts (a written table): the codes of the pieces to remove, by document. docs: doc_id, h (a hash of the text), text."""
    again = bits_of(_counts(docs, o), "k")
    found = _members(docs, again, None, o)
    lines = found.filter("code is null").groupBy("h", "key").agg(F.lit(1).alias("one"))
    clashing = cut(lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "clashes")
    if not clashing.isEmpty():
        found = _members(docs, again, bits_of(clashing, "h"), o)
    members = found.filter("code is not null")
    first = members.groupBy("key").agg(F.min(F.struct("doc_id", "h", "code")).alias("p")).select("p.doc_id", "p.h", F.lit(None).cast("long").alias("code"), F.col("p.code").alias("stays"))
    places = members.select("doc_id", "h", "code", F.lit(None).cast("long").alias("stays")).unionByName(first)
    lists = places.groupBy("doc_id", "h").agg(F.array_except(F.collect_list("code"), F.collect_list("stays")).alias("cuts"))
    return cut(lists.filter(F.size("cuts") > 0), "cuts")


def _left(s: X.Slice, gone: list[list[int] | None], o: ChunkOptions) -> list[tuple[bytes, int, int, int, int]]:
    """Of each document: the text without the lines that go, its lines, and the lines, chunks and passages removed."""
    m = Lines(s, o)
    n = len(m.doc)
    kind, a, b = m.pieces()
    code = (a - m.before[m.doc[a]]) * 4 + kind if len(a) else a
    off = np.zeros(n + 1, np.int64)
    chunks, passages = np.zeros(s.docs, np.int64), np.zeros(s.docs, np.int64)
    want = [np.array(g or [], np.int64) for g in gone]
    doc = np.concatenate([np.full(len(g), i) for i, g in enumerate(want)]) if want else np.zeros(0, np.int64)
    big = np.int64(1 << 40)
    go = np.isin(m.doc[a] * big + code, doc * big + np.concatenate(want)) if len(a) else np.zeros(0, bool)
    kind, a, b = kind[go], a[go], b[go]
    alone = kind != PAIR
    np.add.at(off, a[alone], 1)
    np.add.at(off, b[alone], -1)
    chunks += np.bincount(m.doc[a[kind == CHUNK]], minlength=s.docs)
    # runs of pairs: the next pair begins where this one ends
    x, y = a[~alone], b[~alone]
    if len(x):
        new = np.concatenate([[True], x[1:] != y[:-1] - 1])
        x, y = x[new], y[np.append(new[1:], True)]
        words = np.concatenate([[0], np.cumsum(m.words)])
        ok = words[y] - words[x] >= o.run_words
        x, y = x[ok], y[ok]
        np.add.at(off, x, 1)
        np.add.at(off, y, -1)
    long = a[kind == LONG]
    inside = np.searchsorted(x, long, "right") - 1
    free = (inside < 0) | (y[np.maximum(inside, 0)] <= long) if len(x) else np.ones(len(long), bool)
    passages += np.bincount(np.concatenate([m.doc[x], m.doc[long[free]]]).astype(np.int64), minlength=s.docs)
    off = np.cumsum(off[:-1]) > 0
    out = []
    for i in range(s.docs):
        lo, hi = m.before[i], m.before[i + 1]
        kept = np.flatnonzero(~off[lo:hi]) + lo
        out.append((b"\n".join([m.line(j) for j in kept.tolist()]), int(hi - lo), int(hi - lo) - len(kept), int(chunks[i]), int(passages[i])))
    return out


def line_dedup(docs: DataFrame, options: ChunkOptions = ChunkOptions(), name: str = "line_chunks") -> DataFrame:
    """docs with the struct column `name` of FIELDS: the text that is left and what was removed (a line in a chunk and a passage counts once)."""
    free_name(docs, name)
    taken = [*docs.columns, name]
    h, cuts, gone_id, gone_h = (taken.append(fresh(taken, n)) or taken[-1] for n in ("h", "cuts", "gone_id", "gone_h"))
    gone = removals(text_and_id(docs, F.xxhash64(docs["text"].cast("string")).alias("h")), options)
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_h), F.col("cuts").alias(cuts))
    known = bits_of(gone.select(F.xxhash64(gone_id, gone_h).alias("d")), "d")
    both = docs.withColumn(h, F.xxhash64(docs["text"].cast("string")))
    touched = marked_by(known, F.xxhash64(F.col("doc_id").cast("long"), F.col(h)), docs.sparkSession)
    met = both.filter(touched).join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.col(h) == F.col(gone_h)), "left").drop(h, gone_id, gone_h)
    text, none = F.col("text").cast("string"), F.lit(0).cast("long")
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    rest = both.filter(~touched).drop(h).withColumn(name, F.struct(text.alias("text"), n_lines.alias("n_lines"), *(none.alias(c) for c in FIELDS.fieldNames()[2:]))).drop("text")

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, lists = batch.column("text"), batch.column(cuts).to_pylist()
        rows: list[tuple] = []
        for t, g in zip(texts, lists):
            raw = t.as_buffer().to_pybytes() if t.is_valid and not g else b""
            rows.append((raw, raw.count(b"\n") + 1, 0, 0, 0) if t.is_valid else (None, 0, 0, 0, 0))
        at = [i for i, g in enumerate(lists) if g and rows[i][0] is not None]
        if at:
            some, lo = texts.take(pa.array(at)), 0
            for s in X.slices(some):
                for i, row in zip(at[lo : lo + s.docs], _left(s, [lists[j] for j in at[lo : lo + s.docs]], options)):
                    rows[i] = row
                lo += s.docs
        cols = list(zip(*rows))
        return [pa.array(cols[0], pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])]

    return annotate(met, name, FIELDS, work, drop_text=True).drop(cuts).unionByName(rest)


def dedup_text(docs: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """docs with repeated chunks and runs of lines taken out of the texts; n_chars, where there is one, follows."""
    name = fresh(docs.columns, "line_chunks")
    made = line_dedup(docs, options, name)
    new = {"text": F.col(f"{name}.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(f"{name}.text").cast(docs.schema["n_chars"].dataType)
    return made.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


#: Rule 1 as chunks by an ordered sum of boundaries, rule 2 as islands of repeated pairs.
ORACLE = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM s),
v AS (SELECT *, CAST(concat('0x', substr(md5(line), 1, 8)) AS BIGINT) AS v, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
b AS (SELECT *, ((v % 1000003) + 31 * coalesce(lag(v, 1) OVER o, 0) + 961 * coalesce(lag(v, 2) OVER o, 0)) % 1000003 < 333335 AS e FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, count(*) FILTER (e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM b),
g AS (SELECT doc_id, c, min(i) AS a, max(i) AS z, string_agg(line, chr(10) ORDER BY i) AS t FROM c GROUP BY doc_id, c HAVING count(*) >= 2 AND sum(n) > 0),
gc AS (SELECT doc_id, a, z FROM g QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, a) > 1),
w AS (SELECT doc_id, i, n, row_number() OVER o AS k, lead(i) OVER o AS j FROM v WHERE n > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT w.doc_id, k FROM w JOIN s ON s.doc_id = w.doc_id WHERE j IS NOT NULL QUALIFY row_number() OVER (PARTITION BY array_to_string(ls[i : j], chr(10)) ORDER BY w.doc_id, i) > 1),
q AS (SELECT doc_id, min(k) AS x, max(k) + 1 AS y FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS isle FROM p) GROUP BY doc_id, isle),
r AS (SELECT q.doc_id, min(w.i) AS a, max(w.i) AS z FROM q JOIN w ON w.doc_id = q.doc_id AND w.k BETWEEN x AND y GROUP BY q.doc_id, x HAVING sum(n) >= 50),
o AS (SELECT doc_id, i AS a, i AS z FROM v WHERE n >= 50 QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1),
f AS (SELECT * FROM r UNION ALL SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = o.doc_id AND o.a BETWEEN r.a AND r.z)),
x AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM (SELECT * FROM gc UNION ALL SELECT * FROM f)),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(x.i) AS n_removed_lines, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (x.i IS NULL), '') AS text FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.i = l.i GROUP BY l.doc_id),
nc AS (SELECT doc_id, count(*) AS n FROM gc GROUP BY doc_id),
nf AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(nc.n, 0) AS BIGINT) AS n_removed_chunks,
  CAST(coalesce(nf.n, 0) AS BIGINT) AS n_removed_passages, md5(t.text) AS text_md5
FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN nc USING (doc_id) LEFT JOIN nf USING (doc_id)
"""
