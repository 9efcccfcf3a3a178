"""Spelling variants: words that differ by one code point, grouped without making pairs.

Plan
1. The words of whole texts are counted in the tasks (distinct runs of a document first, since a run's fate depends on document and run alone), summed
   by word, and those of `min_length` code points and `min_count` occurrences are the vocabulary, a written table.
2. Each word goes into one wildcard group for each of its positions, (position, prefix, suffix) as one key: two words of a group differ by exactly that
   code point, and no two words meet in two groups. For insertions and deletions each word goes under every word that is left when one code point is
   dropped, and under itself. One window over the keys gives each group's size and its first two words (by n, then word); a word's best
   partner is the first of its group, or the second if it is the first itself. What comes out is a row per word and group, never a pair.
   A group has one word per letter of the alphabet at most (times the length for dropped code points), so no key is hot.
3. Sizes are summed and best partners compared by word. Forms are followed by pointer doubling over a written table; a form has at least `factor`
   times the word's n, so a chain is as long as the logarithm of the largest n and the rounds few.

Words beyond `literal` code points stand in keys as lengths and 127-bit fingerprints of prefix and suffix, so that a very long word costs time in proportion to
its length and not to its square.

Defined cases: null texts have no words; a null doc_id counts as the empty text in the hash; repeated rows count as often as they stand there; ties go to the smallest word
in code-point order; very long texts are read in windows that end between words; an empty table gives an empty result; other columns of the
input are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravel.llm.common import cut, text_and_id


@dataclass(frozen=True)
class SpellingOptions:
    min_length: int = 6
    min_count: int = 5
    factor: int = 5
    #: One of so many runs loses a code point (the rule that makes variants in clean texts); 0: none.
    damage: int = 199
    literal: int = 128


RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
WINDOW = 1 << 20
HELD = 1 << 17
PRIME, BASE = (1 << 127) - 1, 0x2545F4914F6CDD1D9E3779B97F4A7C15 % ((1 << 127) - 1)


def runs_of(text: str) -> Counter:
    """How often each run stands in a text."""
    out: Counter = Counter()
    at = 0
    while at < len(text):
        end = min(at + WINDOW, len(text))
        rest = RUN.match(text, end)
        end = rest.end() if rest else end
        out.update(RUN.findall(text, at, end))
        at = end
    return out


def words_of(doc_id: int | None, text: str | None, o: SpellingOptions) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a document, after lower-casing A-Z and the damage; a word may come more than once."""
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs_of(text or "").items():
        run = run.lower() if run.isascii() else run.translate(LOWER)
        if o.damage:
            h = zlib.crc32(run.encode(), before)
            if h % o.damage == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
        if len(run) >= o.min_length:
            yield run, n


def vocabulary(docs: DataFrame, o: SpellingOptions = SpellingOptions()) -> DataFrame:
    """word, n of the words that count, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for word, n in words_of(doc_id, text.as_py(), o):
                    held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    counted = text_and_id(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return cut(counted.filter(F.col("n") >= o.min_count), "vocabulary")


def keys_of(word: str, o: SpellingOptions) -> Iterator[tuple[str, int]]:
    """(key, kind) of a word: its wildcard groups (0), what is left without one code point (1), and itself (2)."""
    n = len(word)
    fresh = [i for i in range(n) if not i or word[i] != word[i - 1]]
    if n > o.literal:
        up, size = [0], [1]
        for c in map(ord, word):
            up.append((up[-1] * BASE + c) % PRIME)
            size.append(size[-1] * BASE % PRIME)
        tail = [(up[n] - up[i] * size[n - i]) % PRIME for i in range(n + 1)]
        for i in range(n):
            yield f"?{n}:{i}:{up[i]:x}:{tail[i + 1]:x}", 0
        yield f"={n}:{up[n]:x}", 2
        if n - 1 > o.literal:
            for i in fresh:
                yield f"={n - 1}:{(up[i] * size[n - i - 1] + tail[i + 1]) % PRIME:x}", 1
            return
    else:
        for i in range(n):
            yield f"{word[:i]}?{word[i + 1 :]}", 0
        yield word, 2
    for i in fresh:
        yield word[:i] + word[i + 1 :], 1


def _keys(vocab: DataFrame, o: SpellingOptions) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.int32()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["key", "kind", "word", "n"])

        keys, kinds, words, counts = [], [], [], []
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for key, kind in keys_of(word, o):
                    keys.append(key), kinds.append(kind), words.append(word), counts.append(n)
                    # a long word does not fill a batch with copies of itself
                    if len(keys) * (64 + len(word)) > 4 << 20:
                        yield out()
                        keys, kinds, words, counts = [], [], [], []
        if keys:
            yield out()

    return vocab.mapInArrow(run, "key string, kind int, word string, n long")


def near(vocab: DataFrame, o: SpellingOptions = SpellingOptions()) -> DataFrame:
    """word, n_near, form, form_n of the words that have near ones: how many, and the one of largest n (of equals the smallest)."""
    rows = _keys(vocab, o)
    w = Window.partitionBy("key").orderBy(F.desc(F.col("kind") == 2), F.desc("n"), "word")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    rows = rows.select(
        "word", "kind", F.row_number().over(w).alias("at"), F.count(F.lit(1)).over(whole).alias("size"), F.first("kind").over(whole).alias("first_kind"), F.first(me).over(whole).alias("first"), F.lead(me).over(w).alias("next")
    )
    left_out = F.col("kind") == 1
    rows = rows.withColumn("n", F.when(~left_out, F.col("size") - 1).when(F.col("first_kind") == 2, 1).otherwise(0))
    best = F.when(~left_out & (F.col("at") == 1), F.col("next")).otherwise(F.col("first"))
    out = rows.filter("n > 0").groupBy("word").agg(F.sum("n").alias("n_near"), F.min(best).alias("best"))
    return out.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for forms (word, form): the last form of each chain. Each round follows twice as many steps as the one before, over a written table."""
    state = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not state.filter("moved").isEmpty():
        step = state.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = state.join(step, "root", "left")
        state = cut(joined.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "forms")
    return state.select("word", "root")


def variants(docs: DataFrame, o: SpellingOptions = SpellingOptions()) -> DataFrame:
    """word, form, root, n, n_near, form_n: the vocabulary of docs (doc_id, text) with each word's more frequent form, and the last of its forms."""
    vocab = vocabulary(docs, o)
    rows = vocab.join(near(vocab, o), "word", "left")
    strong = F.coalesce(F.col("form_n") >= o.factor * F.col("n"), F.lit(False))
    rows = cut(rows.select("word", F.when(strong, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("form_n")).alias("form_n")), "variants")
    last = roots(rows.filter("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 bit by bit for its table, then byte by byte; near words by their wildcard forms.
ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
r AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)),
d AS (SELECT doc_id, r, count(*) AS n, hex(encode(concat(doc_id, ':', r))) AS x FROM r GROUP BY doc_id, r),
h AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: CAST(concat('0x', substr(x, i, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM d, tab),
w AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(r, 1, h % length(r)), substr(r, h % length(r) + 2)) ELSE r END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
k AS (SELECT word, n, concat(substr(word, 1, i - 1), '?', substr(word, i + 1)) AS k FROM p),
m AS (SELECT DISTINCT word, n, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS k FROM p),
e AS (SELECT a.word, b.word AS other, b.n FROM k a JOIN k b ON a.k = b.k AND a.word <> b.word
  UNION ALL SELECT m.word, v.word, v.n FROM m JOIN v ON v.word = m.k UNION ALL SELECT v.word, m.word, m.n FROM m JOIN v ON v.word = m.k),
b AS (SELECT word, other, n AS best, count(*) OVER (PARTITION BY word) AS n_near FROM e QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 5 * v.n THEN other END AS form, CASE WHEN best >= 5 * v.n THEN best END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
c AS (SELECT word, word AS last, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.next)
SELECT f.word, form, last AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL
"""
