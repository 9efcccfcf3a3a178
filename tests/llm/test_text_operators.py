"""Quality rules, near join, line chunks and decontamination against plain versions; odd rows; clashing columns."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_support import plain_groups, plain_shingles
from pyspark.sql import functions as F

from ravel.llm import decontaminate, line_chunks, near_join, quality_rules
from ravel.llm import textcore as X
from ravel.llm.common import bits_of, read, text_and_id

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    t = text or ""
    w = SPACE.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = set()
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            cover |= set(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover), failed


def plain_llr(texts, trusted, o):
    def buckets(t):
        b = (t or "").encode()
        for i in range(len(b) - o.n + 1):
            k = int.from_bytes(b[i : i + o.n], "big")
            yield (((k * 0x9E3779B97F4A7C15) % (1 << 64)) >> 40) & (o.buckets - 1)

    q, p = Counter(), Counter()
    for t, good in zip(texts, trusted):
        for b in buckets(t):
            q[b] += 1
            p[b] += good
    n, m = sum(q.values()), sum(p.values())
    out = []
    for t in texts:
        s = [math.log((p[b] + o.alpha) / (m + o.alpha * o.buckets)) - math.log((q[b] + o.alpha) / (n + o.alpha * o.buckets)) for b in buckets(t)]
        out.append(sum(s) / max(1, len(s)))
    return out


@pytest.mark.parametrize("bits", [1 << 26, 64])  # with 64 most documents pass both filters
def test_quality_rules_equal_plain_version(spark, odd, sf_dir, bits):
    o = quality_rules.QualityOptions(filter_bits=bits)
    docs = text_and_id(odd).union(text_and_id(read(spark, sf_dir, "documents")).filter("doc_id between 20 and 60"))
    good = spark.createDataFrame([(1,), (2,), (8,), (21,), (30,), (40,), (1,), (None,)], "doc_id long")
    rows = quality_rules.quality_rules(docs, good, o).select("doc_id", "text", "quality_rules.*").collect()
    texts = [r.text for r in rows]
    llr = plain_llr(texts, [r.doc_id in (1, 2, 8, 21, 30, 40) for r in rows], o)
    for r, x in zip(rows, llr):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(r.text)
        assert abs(r.llr - x) < 1e-6 and r.kept == (not r.base_failed and r.llr >= o.threshold)


def test_quality_rules_tell_junk_from_prose(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    got = quality_rules.quality_rules(docs, quality_rules.trusted_ids(labels), drop_text=True).join(labels, "doc_id").filter("not quality_rules.base_failed")
    r = got.agg(F.avg((F.col("quality_rules.kept") == (F.col("quality") == 1)).cast("int")).alias("a")).first()
    assert r.a > 0.95


def test_similarity_join_equals_plain_version(spark, odd):
    rows = odd.select("doc_id", "text").collect()
    groups, counts = plain_groups([r.text for r in rows])
    got = near_join.similarity_join(odd).collect()
    first = {}
    for r, g in zip(rows, groups):
        first[g] = min([x for x in (first.get(g), r.doc_id) if x is not None], default=None)
    want = Counter((r.doc_id, first[g] if first[g] is not None else r.doc_id, n) for r, g, n in zip(rows, groups, counts))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want


def test_large_near_group_is_counted_exactly_across_blocks(spark):
    import random

    r = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(90):
        t = list(base)
        for _ in range(r.randrange(4)):
            t[r.randrange(80)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += ["other text " + str(i) * 5 for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.class_id, x.n_links) for x in near_join.similarity_join(docs, near_join.JoinOptions(block=16)).collect()}
    groups, counts = plain_groups(texts)
    first = {}
    for i, g in enumerate(groups):
        first.setdefault(g, i)
    assert got == {i: (first[g], n) for i, (g, n) in enumerate(zip(groups, counts))}


def test_dense_and_paired_intersections_agree():
    rng = np.random.default_rng(1)
    sets = [X.sorted_unique(rng.integers(0, 300, 120).astype(np.uint64)) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    assert (near_join._common(sets, sets, i, j) == near_join._common_dense(sets, sets, i, j)).all()
    i, j = np.repeat(np.arange(10), 20), np.tile(np.arange(20), 10)
    assert (near_join._common(sets[:10], sets[10:], i, j) == near_join._common_dense(sets[:10], sets[10:], i, j)).all()


def test_posterior_bound_keeps_true_pairs():
    o = near_join.JoinOptions()
    for n, least in near_join.least_matches(o):
        miss = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least))
        assert miss < 1e-4, (n, least, miss)


def test_components_of_long_paths(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("x", "y"), ("y", "z"), ("z", "x"), ("q", "q")]
    got = {r.node: r.root for r in near_join.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {f"{i:03d}": "000" for i in range(61)} | {"x": "x", "y": "x", "z": "x"}


def test_keep_one_of_each_class(spark, clashing, odd):
    got = near_join.keep_one(clashing)
    assert got.columns == clashing.columns
    rows = odd.select("doc_id", "text").collect()
    groups, _ = plain_groups([r.text for r in rows])
    kept = [r.doc_id for r in got.collect()]
    assert len(kept) == len(set(groups))
    assert 1 in kept and 2 not in kept


def plain_ends(lines):
    """Whether a chunk ends after each line: the polynomial of the last three lines' values at 31, modulo 1000003, is in the lowest third."""
    v = [0, 0] + [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    return [3 * ((v[i + 2] + 31 * v[i + 1] + 31 * 31 * v[i]) % 1_000_003) < 1_000_003 for i in range(len(lines))]


def plain_dedup(rows, run_words):
    """What is left of each of (place, text), by rising place: the text, and how many lines, chunks and passages went."""
    seen, out = set(), {}
    docs = [(place, t.split("\n")) for place, t in rows]
    first = {}
    parts = []
    for place, lines in docs:
        n = [len(SPACE.findall(x)) for x in lines]
        chunks, begin = [], 0
        for i, e in enumerate(plain_ends(lines)):
            if e or i + 1 == len(lines):
                if i + 1 - begin >= 2 and sum(n[begin : i + 1]):
                    chunks.append((begin, i))
                begin = i + 1
        worded = [i for i, k in enumerate(n) if k]
        pairs = list(zip(worded, worded[1:]))
        long = [(i, i) for i in worded if n[i] >= 50]
        parts.append((chunks, pairs, long, worded, n))
        for kind, pieces in enumerate((chunks, pairs, long)):
            for a, z in pieces:
                first.setdefault((kind, "\n".join(lines[a : z + 1])), (place, a))
    for (place, lines), (chunks, pairs, long, worded, n) in zip(docs, parts):
        again = lambda kind, a, z: first[(kind, "\n".join(lines[a : z + 1]))] != (place, a)
        gone = [x for x in chunks if again(0, *x)]
        runs, k = [], 0
        while k < len(pairs):
            j = k
            while j < len(pairs) and again(1, *pairs[j]):
                j += 1
            if j > k and sum(n[i] for i in worded[k : j + 1]) >= run_words:
                runs.append((worded[k], worded[j]))
            k = j + 1
        alone = [x for x in long if again(2, *x) and not any(a <= x[0] <= z for a, z in runs)]
        off = {i for a, z in gone + runs + alone for i in range(a, z + 1)}
        out[place] = ("\n".join(x for i, x in enumerate(lines) if i not in off), len(lines), len(off), len(gone), len(runs) + len(alone))
    return out


@pytest.mark.parametrize("run_words,bits", [(50, 64), (0, 64), (50, 5), (0, 3)])
def test_line_dedup_equals_plain_version(spark, odd, run_words, bits):
    import random

    r = random.Random(8)
    vocab = [" ".join(r.choice("abcdefgh") * 3 for _ in range(r.choice([1, 3, 12, 30]))) for _ in range(14)] + ["", " ", "\t", " ".join(f"passage{i}" for i in range(55))]
    extra = [(100 + i, "\n".join(r.choice(vocab) for _ in range(r.randrange(1, 14))), "en", "s", 0) for i in range(60)]
    shared = "\n".join(f"shared line {i} " + "of some words " * 4 for i in range(9))
    extra += [(200 + i, f"own {i}\nmore {i}\n{shared}\nend {i}", "en", "s", 0) for i in range(6)]
    docs = odd.union(spark.createDataFrame(extra + extra[:3], odd.schema))
    hashes = {x.text: x.h for x in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    rows = sorted({((x.doc_id is not None, x.doc_id or 0, hashes[x.text]), x.text) for x in docs.collect() if x.text is not None})
    want = plain_dedup(rows, run_words)
    got = line_chunks.line_dedup(docs.withColumnRenamed("text", "x").withColumn("text", F.col("x")), line_chunks.ChunkOptions(run_words=run_words, hash_bits=bits)).collect()
    assert len(got) == docs.count()
    for x in got:
        m = x.line_chunks
        if x.x is None:
            assert tuple(m) == (None, 0, 0, 0, 0)
        else:
            assert tuple(m) == want[(x.doc_id is not None, x.doc_id or 0, hashes[x.x])]
    assert all(sum(v[k] for v in want.values()) > 0 for k in (2, 3, 4))


def test_line_dedup_keeps_clashing_columns(clashing):
    changed = line_chunks.dedup_text(clashing)
    assert changed.columns == clashing.columns and changed.count() == clashing.count()
    with pytest.raises(ValueError):
        line_chunks.line_dedup(clashing)


def chunk_ends(text):
    """The lines that chunks begin with in the operator."""
    (s,) = X.slices(pa.array([text]))
    return line_chunks.Lines(s, line_chunks.ChunkOptions()).chunk_begins().tolist()


@pytest.mark.parametrize("back", [1, 2, 3])
def test_a_boundary_follows_the_last_three_lines_and_no_other(back):
    made = {3 + back in chunk_ends("\n".join(["x", "y", *(f"{a}" if i == 0 else f"l{i}" for i in range(back)), "same", "z"])) for a in range(30)}
    assert len(made) == (2 if back < 3 else 1)


def test_chunks_do_not_follow_shifts():
    run = [f"line number {i} of a shared run" for i in range(400)]

    def of(before):
        begin = [i - len(before) for i in chunk_ends("\n".join([*before, *run]))]
        return {i for i in begin if i >= 3}  # the first two lines of the run have others in their window

    want = of([])
    assert 90 < len(want) < 180
    for k in range(1, 12):
        assert of([f"other {k} {j}" for j in range(k)]) == want


def test_runs_of_short_lines_go_between_any_neighbours(spark):
    run = [" ".join(f"w{i}x{j}" for j in range(9)) for i in range(7)]
    texts = [[f"own {d} a", f"own {d} b", *run, f"end {d}", ""] for d in range(40)]
    texts += [["a b", "c d", "a b", "c d", "a b"], ["c d", "a b", "e"], ["c d", "x"], ["", "c d", ""]]
    docs = spark.createDataFrame([(d, "\n".join(t), 0) for d, t in enumerate(texts)], "doc_id long, text string, n_chars long").repartition(3)
    left = {r.doc_id: r.text.split("\n") for r in line_chunks.dedup_text(docs).collect()}
    assert left[0] == texts[0]
    for d in range(1, 40):
        assert left[d][:2] == texts[d][:2] and f"end {d}" in left[d] and not set(run) & set(left[d]), d
    assert left[42] == ["c d", "x"]
    assert {x for t in texts for x in t} == {x for t in left.values() for x in t}


def test_the_stage_rests_on_chunks(spark):
    """Two neighbouring common lines between others stay, unless a chunk ends before and behind them; without chunks all of them stay."""
    texts = [f"own {d} a\nown {d} b\nsee also\nshare this\nown {d} c\nown {d} d" for d in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id: r.text for r in line_chunks.dedup_text(docs).collect()}

    def is_chunk(t):
        begin = chunk_ends(t)
        return 2 in begin and 3 not in begin and 4 in begin

    seen = False
    for d, t in enumerate(texts):
        assert left[d] == (t.replace("see also\nshare this\n", "") if seen and is_chunk(t) else t)
        seen = seen or is_chunk(t)
    assert seen and sum(map(is_chunk, texts)) < 30
    without = line_chunks.dedup_text(docs, line_chunks.ChunkOptions(min_lines=1 << 30))
    assert {r.doc_id: r.text for r in without.collect()} == dict(enumerate(texts))


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_hits(text, items, n=10):
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        v = ALNUM.findall((t or "").translate(LOWER))
        k = min(n, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(w), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("table_bytes", [64 << 20, 40])  # the second: a join in place of the broadcast table
def test_decontamination_equals_plain_version(spark, tables, clashing, table_bytes):
    docs, bench = read(spark, tables["full"], "documents"), read(spark, tables["full"], "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect() if r.item_id is not None]
    o = decontaminate.DecontaminationOptions(table_bytes=table_bytes)
    rows = decontaminate.find(docs, bench, o).select("text", "decontamination.*").collect()
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"]) == plain_hits(r.text, items)
    assert sum(r.n_hit > 0 for r in rows) == 2
    assert decontaminate.remove_documents(clashing, bench, o).columns == clashing.columns
    left = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench, o).collect()}
    assert left[7] == "" and len(left[8]) < len(docs.filter("doc_id = 8").first().text)
    assert all(plain_hits(t, items)[1] == 0 for t in left.values())


def test_both_ways_give_the_same_spans_for_many_items(spark):
    import random

    r = random.Random(6)
    text = lambda n: " ".join(r.choice("ab") + str(r.randrange(4)) for _ in range(n))
    items = [(str(i % 90) if i % 9 else None, text(r.choice([0, 1, 2, 5, 10, 11, 14]))) for i in range(120)]
    docs = [(i, text(r.choice([3, 12, 60, 300])) + " " + r.choice(items)[1].upper() + " - " + text(5)) for i in range(80)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = []
    for table_bytes in (64 << 20, 1):
        o = decontaminate.DecontaminationOptions(table_bytes=table_bytes, unnamed=True)
        got.append({x.doc_id: x.decontamination for x in decontaminate.find(df, bench, o).collect()})
    assert got[0] == got[1]
    for i, t in docs:
        n, hit, found = plain_hits(t, items)
        assert (got[0][i].n_words, got[0][i].n_hit, got[0][i]["items"]) == (n, hit, [x for x in found if x != "None"])


def test_built_windows_stay_within_their_bound():
    import random

    r = random.Random(7)
    for word in ("a", "some longer words"):
        items = [(str(i), " ".join(r.choice(word.split()) for _ in range(2000))) for i in range(50)]
        w = decontaminate.Windows(items, 10)
        assert w.nbytes() <= decontaminate.BUILT * sum(len(t) for _, t in items)
    many = [(str(i), " ".join(f"{r.randrange(10**6):06d}" for _ in range(3000))) for i in range(50)]
    assert decontaminate.Windows(many, 10).nbytes() < 6 * sum(len(t) for _, t in many)


def test_bit_filter_never_misses(spark):
    df = spark.createDataFrame([(i * 7919 - 10**6,) for i in range(500)], "k long")
    bits = bits_of(df, "k")
    assert bits.may_have(np.array([i * 7919 - 10**6 for i in range(500)], np.int64)).all()
    assert bits.may_have(np.arange(10**9, 10**9 + 2000, dtype=np.int64)).mean() < 0.3
    assert not bits_of(df.filter("k is null"), "k").may_have(np.arange(50, dtype=np.int64)).any()


def test_slices_hold_whole_documents():
    texts = ["a" * 100, None, "", "é" * 300_000, "b"]
    got = [s.text(i).decode() for s in X.slices(pa.array(texts)) for i in range(s.docs)]
    assert got == [t or "" for t in texts]
    got = [s.text(i).decode() for s in X.slices(pa.array(texts).slice(2)) for i in range(s.docs)]
    assert got == [t or "" for t in texts[2:]]


def test_plain_shingles_of_short_texts():
    assert plain_shingles("One two") == {("one", "two")} and plain_shingles("") == set()


def test_items_without_id_count_as_hits(spark, tables):
    import duckdb
    from support import same_rows

    import corpus_pipeline
    from ravel.llm import queries

    d = tables["full"]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT DISTINCT doc_id, text FROM '{d}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
    c.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{d}/benchmark.parquet/*.parquet'")
    name = "op5_benchmark_decontamination"
    got = queries.queries()[name](spark, d).filter("doc_id is not null").distinct()
    same_rows(got.toPandas(), c.execute(queries.oracle_sql()[name]).df())
    assert got.filter("doc_id = 6 and n_hit = 1 and n_items = 0 and contaminated").count() == 1
    left = dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, read(spark, d, "documents"), d)
    assert left.filter("doc_id in (6, 7, 8)").count() == 0
