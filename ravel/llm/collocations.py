"""Collocations: phrases of 2 to 4 words by hierarchical pair naming.

Plan
1. Tasks cut their texts into blocks of about `block` words. A block is a row of small local codes, one a word, 0 where a piece ends, and its distinct words with
   the times they stand there, dealt over buckets by hash. What a block has in one bucket is one row of packed arrays.
2. Naming: a bucket's rows of all blocks meet in one task, at most a row a block for each of its words (later: pairs), so no word is hot. Those found `least`
   times or more get an id, (bucket, rank in order), which only depends on the contents. The ids go back, packed, to the blocks they came from.
3. In each block the ids of adjacent (k-1)-grams make pairs, and a pair stands for the k-gram that both overlap in; its (left id, right id, times) are named
   in turn. A k-gram is as frequent as its least part at most, so nothing that counts is lost by going on with frequent ones only.
4. The named tables are a hierarchy: left and right are the two (k-1)-grams of a phrase. Cuts and their counts come from the parents (first word, first pair,
   last pair, ...), texts too, and a phrase's most frequent longer neighbour is the largest count among its children. (A four-word phrase around a
   pair has a three-word one around it that is at least as frequent, so the next level is enough.)
5. The first `top` of each lang: first of each of many salted shares, then of what they leave.

No id is a hash, so counts are exact. Scores are whole numbers in decimal arithmetic of 38 digits, as 2,000,000 times a count can pass 64 bits. The number of buckets
follows the bytes and words of the input, so that a bucket fits in a task.

Defined cases: null texts have no words; a null lang is `und`, together with a lang of that name; repeated rows count as often as they stand there; ties go by count, then the
phrase's UTF-8 bytes; a very long text is read in windows and may span blocks, the next block then begins with the last three words before
it, which count only as the beginning of phrases; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravel.llm import textcore as X
from ravel.llm.common import cut, forget, small_batches


@dataclass(frozen=True)
class CollocationOptions:
    least: int = 30
    #: A phrase goes if a longer one around it has this share (in hundredths) of its count.
    share: int = 80
    top: int = 2000
    longest: int = 4
    block: int = 1 << 18
    window: int = 1 << 20
    #: Bytes of text, and words, for which there is a bucket.
    bucket_bytes: int = 8 << 20
    bucket_words: int = 2 << 20


#: A-Z to a-z, tab to space, the ends of pieces to newline.
BYTES = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
BREAK = b"\n"
#: Bits of a rank in an id, and of a block's number within its task.
RANK_BITS, BLOCK_BITS = 40, 20
SALTS = 64
#: A block's codes, or what it has in one bucket: words (by lang) or pairs, the local codes of which begin with `first`.
_PARTS = "block long, skip int, codes binary, bucket int, lang string, first int, words binary, data binary"
#: Ids for codes of a block, or one named word or pair.
_NAMED = "block long, first int, data binary, id long, f long, lang string, word string, left long, right long"
_CODEC = pa.Codec("zstd", 3)


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length and type as planes of bytes, compressed: the high bytes of small numbers cost nothing."""
    return squeeze(b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays))


def unpack(data: bytes, k: int, dtype: type = np.int64) -> list[np.ndarray]:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(unsqueeze(data), np.uint8).reshape(k, size, -1)
    return [np.ascontiguousarray(x.T).view(dtype).ravel() for x in raw]


def _rows(schema: str, **columns: list) -> pa.RecordBatch:
    """A batch of the schema; columns that are not given are null."""
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    n = len(next(iter(columns.values())))
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], types[t]) if c in columns else pa.nulls(n, types[t]) for c, t in fields], names=[c for c, _ in fields])


class Names(dict):
    """The local codes of one lang's words, from a counter that all langs of a block share."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        super().__init__({b"": -1, BREAK: 0})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        self[word] = len(self.words)
        return len(self.words)


class Block:
    def __init__(self, number: int, lang: str | None = None, before: list[bytes] = ()):
        self.number, self.words, self.names, self.codes, self.size = number, [], {}, [], 0
        self.skip = len(before)
        if before:
            self.add(lang, before)

    def add(self, lang: str, tokens: list[bytes]) -> None:
        names = self.names.get(lang)
        if names is None:
            names = self.names[lang] = Names(lang, self.words)
        codes = np.fromiter(map(names.__getitem__, tokens), np.int32, len(tokens))
        self.codes.append(codes[codes >= 0])
        self.size += len(self.codes[-1])

    def rows(self, buckets: int) -> pa.RecordBatch:
        codes, m = np.concatenate(self.codes), len(self.words)
        n = np.bincount(codes[self.skip :], minlength=m + 1)[1:]
        langs = {x: i for i, x in enumerate(self.names)}
        lang = np.array([langs[x] for x, _ in self.words], np.int64)
        bucket = np.array([zlib.crc32(w) % buckets for _, w in self.words], np.int64)
        order = np.lexsort((lang, bucket))
        new = np.zeros(m + 1, np.int32)
        new[order + 1] = np.arange(1, m + 1)
        lang, bucket = lang[order], bucket[order]
        at = [*np.flatnonzero(np.concatenate([[m > 0], (lang[1:] != lang[:-1]) | (bucket[1:] != bucket[:-1])])).tolist(), m]
        names, order = list(self.names), order.tolist()
        spans = list(zip(at, at[1:]))
        k = len(spans)
        words = [squeeze(b"\n".join([self.words[i][1] for i in order[a:b]])) for a, b in spans]
        data = [pack(n[order[a:b]]) for a, b in spans]
        return _rows(
            _PARTS, block=[self.number] * (k + 1), skip=[self.skip] + [None] * k, codes=[pack(new[codes])] + [None] * k, bucket=[None, *bucket[at[:-1]].tolist()],
            lang=[None, *(names[lang[a]] for a, _ in spans)], first=[None, *(a + 1 for a, _ in spans)], words=[None, *words], data=[None, *data],
        )


def tokens_of(text: bytes, window: int) -> Iterator[list[bytes]]:
    """The words of a text, with a BREAK at each end of a piece (and empty ones that do not count), in windows."""
    raw = text.translate(BYTES)
    at = 0
    while at < len(raw):
        end = at + window
        if end < len(raw):
            end = min(x if x >= 0 else len(raw) for x in (raw.find(b" ", end), raw.find(BREAK, end)))
        yield raw[at:end].replace(BREAK, b" \n ").split(b" ")
        at = end


def blocks(docs: DataFrame, o: CollocationOptions) -> DataFrame:
    """The blocks of docs (lang, text) as a written table: their codes and, by bucket and lang, their words."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text"))
    buckets = _buckets(rows.agg(F.sum(F.octet_length("text"))).first()[0], o.bucket_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << BLOCK_BITS
        now = Block(part)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if not text.is_valid:
                    continue
                last: list[bytes] = []
                for tokens in tokens_of(text.as_buffer().to_pybytes(), o.window):
                    if now.size >= o.block:
                        yield now.rows(buckets)
                        now = Block(now.number + 1, lang, last)
                    now.add(lang, tokens)
                    last = ([*last, *(t for t in tokens[-2 * o.longest :] if t)])[-(o.longest - 1) :]
                now.add(lang, [BREAK])
        if now.size:
            yield now.rows(buckets)

    return cut(rows.mapInArrow(run, _PARTS), "blocks", "uncompressed")


def _buckets(size: int | None, each: int) -> int:
    return max(32, math.ceil((size or 0) / each))


def name_words(parts: DataFrame, least: int) -> DataFrame:
    """Ids for the words of a bucket's rows, and the named words, as a written table."""

    def work(t: pa.Table) -> pa.Table:
        rows = [(block, lang, first, unsqueeze(words).split(b"\n"), unpack(n, 1)[0].tolist()) for block, lang, first, words, n in zip(*(t[c].to_pylist() for c in ("block", "lang", "first", "words", "data")))]
        total: dict[str, dict[bytes, int]] = {}
        for _, lang, _, words, n in rows:
            f = total.setdefault(lang, {})
            for w, c in zip(words, n):
                f[w] = f.get(w, 0) + c
        # frequent words have small ranks, which pack best
        entries = sorted(((lang, w, n) for lang, f in total.items() for w, n in f.items() if n >= least), key=lambda e: (-e[2], e[0], e[1]))
        base = t["bucket"][0].as_py() << RANK_BITS
        ids: dict[str, dict[bytes, int]] = {lang: {} for lang in total}
        for i, (lang, w, _) in enumerate(entries, 1):
            ids[lang][w] = base | i
        back = []
        for block, lang, first, words, _ in rows:
            got = np.fromiter((ids[lang].get(w, 0) for w in words), np.int64, len(words))
            back.append((block, first, np.flatnonzero(got), got))
        langs, words, f = (list(x) for x in zip(*entries)) if entries else ([], [], [])
        return pa.Table.from_batches([_back(back), _rows(_NAMED, id=[base | i for i in range(1, len(entries) + 1)], f=f, lang=langs, word=pa.array(words, pa.binary()).cast(pa.string()))])

    return cut(parts.groupBy("bucket").applyInArrow(work, _NAMED), "named", "uncompressed")


def _back(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(block, first code, places, ids by place) as rows for the blocks, without rows that name nothing."""
    rows = [r for r in rows if len(r[2])]
    return _rows(_NAMED, block=[r[0] for r in rows], first=[r[1] for r in rows], data=[pack(np.diff(at, prepend=0), np.diff(got[at], prepend=0)) for _, _, at, got in rows])


def name_pairs(parts: DataFrame, least: int, last: bool) -> DataFrame:
    """Ids for the pairs of a bucket's rows (not for the last level, whose ids nobody asks for), and the named pairs, as a written table."""

    def work(t: pa.Table) -> pa.Table:
        each = [unpack(x, 3) for x in t["data"].to_pylist()]
        size = np.array([len(x[0]) for x in each])
        left, right, n = np.concatenate([np.cumsum(x[0]) for x in each]), np.concatenate([x[1] for x in each]), np.concatenate([x[2] for x in each])
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        at = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        f = np.add.reduceat(n[order], at)
        often = f >= least
        base = t["bucket"][0].as_py() << RANK_BITS
        names = np.where(often, base | np.cumsum(often), 0)
        out = [_rows(_NAMED, id=names[often], f=f[often], left=left[at[often]], right=right[at[often]])]
        if not last:
            got = np.empty(len(order), np.int64)
            got[order] = np.repeat(names, np.diff(np.append(at, len(order))))
            begin = np.cumsum(size) - size
            rows = []
            for block, first, a, k in zip(t["block"].to_pylist(), t["first"].to_pylist(), begin.tolist(), size.tolist()):
                own = got[a : a + k]
                rows.append((block, first, np.flatnonzero(own), own))
            out.append(_back(rows))
        return pa.Table.from_batches(out)

    return cut(parts.groupBy("bucket").applyInArrow(work, _NAMED), "named", "uncompressed")


def _pairs(codes: np.ndarray, skip: int, ids: np.ndarray, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The codes of k-grams by place, and bucket, left id, right id and times of each code from 1, in order of these."""
    new = np.zeros(max(len(codes) - 1, 0), np.int32)
    known = ids[codes] > 0
    at = np.flatnonzero(known[:-1] & known[1:])
    key, inverse = np.unique(codes[at].astype(np.int64) << 32 | codes[at + 1], return_inverse=True)
    left, right = ids[key >> 32], ids[key & 0xFFFFFFFF]
    n = np.bincount(inverse[at + k > skip], minlength=len(key))
    bucket = (X.mix(X.mix(left) ^ right.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((right, left, bucket))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    new[at] = rank[inverse]
    return new, bucket[order], left[order], right[order], n[order]


def pairs(sequences: DataFrame, names: DataFrame, k: int, buckets: int) -> DataFrame:
    """The k-grams of blocks whose (k-1)-grams are named: their codes and, by bucket, their pairs, as a written table."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, skip, codes in zip(left["block"].to_pylist(), left["skip"].to_pylist(), left["codes"].to_pylist()):
            (codes,) = unpack(codes, 1, np.int32)
            ids = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
            for first, data in zip(right["first"].to_pylist(), right["data"].to_pylist()):
                at, got = unpack(data, 2)
                ids[first + np.cumsum(at)] = np.cumsum(got)
            new, bucket, a, b, n = _pairs(codes, skip, ids, k, buckets)
            if not len(a):
                continue
            at = [*np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist(), len(a)]
            data = [pack(np.diff(a[x:y], prepend=0), b[x:y], n[x:y]) for x, y in zip(at, at[1:])]
            m = len(data)
            out.append(_rows(_PARTS, block=[block] * (m + 1), skip=[skip] + [None] * m, codes=[pack(new)] + [None] * m, bucket=[None, *bucket[at[:-1]].tolist()], first=[None, *(x + 1 for x in at[:-1])], data=[None, *data]))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_rows(_PARTS, block=[])])

    return cut(sequences.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(work, _PARTS), "pairs", "uncompressed")


def _counted(parts: DataFrame) -> DataFrame:
    """lang and n, the occurrences of all words of a row's packed counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([int(unpack(x, 1)[0].sum()) for x in b.column("data").to_pylist()], pa.int64())], names=["lang", "n"])

    return parts.select("lang", "data").mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def hierarchy(docs: DataFrame, o: CollocationOptions) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Occurrences of words by lang, and for each k the named k-grams: id, f, and lang and word (k = 1) or left and right."""
    rows = blocks(docs, o)
    per_lang = cut(_counted(rows.filter("bucket is not null")), "langs")
    buckets = _buckets(per_lang.agg(F.sum("n")).first()[0], o.bucket_words)
    levels = {}
    for k in range(1, o.longest + 1):
        parts = rows.filter("bucket is not null").drop("codes", "skip")
        names = name_words(parts, o.least) if k == 1 else name_pairs(parts.drop("lang", "words"), o.least, k == o.longest)
        levels[k] = names.filter("id is not null").select("id", "f", *(("lang", "word") if k == 1 else ("left", "right")))
        done = rows
        if k < o.longest:
            rows = pairs(rows.filter("codes is not null").select("block", "codes", "skip"), names.filter("block is not null").select("block", "first", "data"), k + 1, buckets)
        forget(done)
    return per_lang, levels


def _score(a: Column, cuts: list[tuple[Column, Column]]) -> Column:
    """The lowest-scoring cut, of equals the first: score, k, l, r."""
    product = a.cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)")
    each = [F.struct(F.call_function("div", product, x.cast("decimal(20,0)") + y.cast("decimal(20,0)")).alias("score"), F.lit(k).alias("k"), x.alias("l"), y.alias("r")) for k, (x, y) in enumerate(cuts, 1)]
    return F.array_min(F.array(*each))


def phrases(levels: dict[int, DataFrame], o: CollocationOptions) -> DataFrame:
    """lang, phrase, a, best (score, k, l, r), longer (the largest count of a phrase one word longer around it, null without one)."""
    c = F.col
    words = levels[1].select("id", "lang", c("word").alias("phrase"), c("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    out, below = [], words
    for k in range(2, o.longest + 1):
        left = below.select(c("id").alias("left"), "lang", c("phrase").alias("p"), c("heads").alias("heads"))
        right = below.select(c("id").alias("right"), c("last").alias("last"), c("tails").alias("tails"))
        rows = levels[k].join(left, "left").join(right, "right")
        # heads[i]: the count of the first i + 1 words; tails[i]: of the last i + 1
        rows = rows.withColumn("best", _score(c("f"), [(c("heads")[i - 1], c("tails")[k - i - 1]) for i in range(1, k)]))
        rows = rows.withColumn("phrase", F.concat_ws(" ", "p", "last")).withColumn("heads", F.concat("heads", F.array("f"))).withColumn("tails", F.concat("tails", F.array("f")))
        if k < o.longest:
            rows = cut(rows.select("id", "lang", "phrase", "last", "f", "heads", "tails", "best"), "phrases")
            children = levels[k + 1].select(F.explode(F.array_distinct(F.array("left", "right"))).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            done = rows.join(children, "id", "left")
        else:
            done = rows.withColumn("longer", F.lit(None).cast("long"))
        out.append(done.select("lang", "phrase", c("f").alias("a"), "best", "longer"))
        below = rows
    made = out[0]
    for x in out[1:]:
        made = made.unionByName(x)
    return made


def collocations(docs: DataFrame, o: CollocationOptions = CollocationOptions()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each lang of docs (lang, text)."""
    per_lang, levels = hierarchy(docs, o)
    rows = phrases(levels, o)
    wide = lambda name: F.col(name).cast("decimal(20,0)")
    rows = rows.filter(F.coalesce(F.lit(100) * wide("longer") < F.lit(o.share) * wide("a"), F.lit(True)))
    rows = rows.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # a lang may hold most phrases: shares of it are ranked first
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    for by in (["lang", salt], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= o.top)
    return rows.join(per_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(ps) AS p FROM t)),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 5) r(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, p, count(*) AS f FROM g GROUP BY lang, k, p HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, p, f, string_split(p, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT c.lang, c.p, c.f AS a, h, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * c.f) // (l.f + r.f) AS score FROM (SELECT *, unnest(range(1, k)) AS h FROM c) c
  JOIN f l ON l.lang = c.lang AND l.k = h AND l.p = array_to_string(w[1 : h], ' ') JOIN f r ON r.lang = c.lang AND r.k = c.k - h AND r.p = array_to_string(w[h + 1 : c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, h) = 1),
i AS (SELECT lang, f, array_to_string(w[x : x + m - 1], ' ') AS p FROM (SELECT *, unnest(range(1, k - m + 2)) AS x FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
o AS (SELECT lang, p, max(f) AS f FROM i GROUP BY lang, p),
q AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.p = b.p WHERE o.f IS NULL OR 100 * o.f < 80 * b.a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM q)
SELECT z.lang, rank, p AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""
