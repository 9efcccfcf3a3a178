"""The seed walk and bounded-edit extension against plain walks over whole strings."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from ravel.functions.dna import kmer_code
from ravel.operators import align as A
from ravel.operators import extension as E
from ravel.operators import seeding as S
from ravel.schema import AlignOptions


def genome(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def noisy(s, rate, seed):
    r = random.Random(seed)
    out = []
    for c in s:
        if r.random() < rate:
            out.append(r.choice(["", r.choice("ACGT"), c + r.choice("ACGT")]))
        else:
            out.append(c)
    return "".join(out)


def plain_reach(p, q, edits):
    """Letters of p, edits and letters of q of the furthest reach, by the table of distances (cells further than `edits` off its diagonal cost more than that)."""
    d = {}
    for i in range(len(p) + 1):
        for j in range(max(0, i - edits), min(len(q), i + edits) + 1):
            if not i or not j:
                d[i, j] = i + j
                continue
            same = p[i - 1] == q[j - 1] and p[i - 1] in "ACGT"
            d[i, j] = min(d[i - 1, j - 1] + (not same), d.get((i - 1, j), 99) + 1, d.get((i, j - 1), 99) + 1)
    i, e, j = max((i, -x, j) for (i, j), x in d.items() if x <= edits)
    return i, j, -e


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_reaches_equal_the_table_of_distances(edits):
    r = random.Random(edits)
    pairs = []
    for _ in range(150):
        q = "".join(r.choice("ACGT"[: r.choice([1, 2, 4])]) for _ in range(r.randrange(30)))
        pairs.append((noisy(q, 0.15, r.random())[: r.randrange(1, 31)], q))
    pairs += [("", ""), ("A", ""), ("", "A"), ("NNA", "NNA"), ("ACGT" * 100, "ACGT" * 100)]
    p, po = E.letters([x for x, _ in pairs], 0)
    q, qo = E.letters([x for _, x in pairs], 1)
    pn, qn = np.diff(po), np.diff(qo)
    for step in (1, -1):
        t = E.reaches(p, q, po[1:] - 1 if step < 0 else po[:-1], qo[1:] - 1 if step < 0 else qo[:-1], pn, qn, step, edits)
        a, b, e = E.furthest(t, pn, qn)
        lp, lq = np.array([r.randint(0, n) for n in pn]), np.array([r.randint(0, n) for n in qn])
        la, lb, le = E.furthest(t, lp, lq)
        for i, (x, y) in enumerate(pairs[:-1]):
            x, y = x[::step], y[::step]
            assert plain_reach(x, y, edits) == (a[i], b[i], e[i])
            assert plain_reach(x[: lp[i]], y[: lq[i]], edits) == (la[i], lb[i], le[i])
        assert (a[-1], b[-1], e[-1]) == (400, 400, 0)


def test_tiles_from_pieces_equal_tiles_from_whole_contigs(spark):
    g = {"a": genome(5000, 1), "b": genome(1024, 2), "c": genome(3, 3), "d": ""}
    whole = spark.createDataFrame(list(g.items()), "chr string, seq string")
    cut = spark.createDataFrame([(c, i, s[i : i + 61]) for c, s in g.items() for i in range(0, len(s), 61)], "chr string, at long, seq string").repartition(3)
    got = [{(r.chr, r.tile): (r.at, r.seq) for r in E.tiles(x, 512, 100).collect()} for x in (whole, cut)]
    assert got[0] == got[1]
    for c, s in g.items():
        for p in range(len(s)):
            at, seq = got[0][c, p // 512]
            lo, hi = max(0, p - 100), min(len(s), p + 101)
            assert seq[lo - at : hi - at] == s[lo:hi]


@pytest.mark.parametrize("edits,most", [(0, 5000), (2, 5000), (2, 40), (3, 300)])
def test_bounded_extension_equals_plain_version(spark, edits, most):
    g = genome(3000, 5)
    reads = [(f"r{i}", noisy(g[300 + 50 * i : 900 + 50 * i], 0.01, i)) for i in range(8)]
    anchors, want = [], set()
    for name, s in reads:
        for j in range(40, len(s) - 20, 90):
            x = g.find(s[j : j + 16])
            if x >= 0:
                anchors.append((name, "c", j + 1, j + 16, x + 1, x + 16))
                a, u, e = plain_reach(s[max(0, j - most) : j][::-1], g[max(0, x - most) : x][::-1][:800], edits)
                z, v, f = plain_reach(s[j + 16 : j + 16 + most], g[x + 16 : x + 16 + min(most, 800)], edits)
                want.add((name, j + 1 - a, j + 16 + z, x + 1 - u, x + 16 + v, e + f))
    df = spark.createDataFrame(anchors, "read_id string, chr string, rd_l long, rd_r long, rf_l long, rf_r long")
    out = E.bounded_extension(df, spark.createDataFrame(reads, "read_id string, seq string"), spark.createDataFrame([("c", g)], "chr string, seq string"), ["read_id"], edits, most)
    got = {(r.read_id, r.rd_l, r.rd_r, r.rf_l, r.rf_r, r.edits) for r in out.collect()}
    assert got == want and len(anchors) > 30


def all_places(refs, o, copies):
    where = defaultdict(list)
    for c, s in refs.items():
        for i in range(len(s) - o.k + 1):
            where[s[i : i + o.k]].append((c, i))
    return {x: at for x, at in where.items() if len(at) <= copies}


def plain_walk(read, refs, o, size, where):
    """The walk over one read in whole strings. where: the places of each k-mer that may be looked up."""
    hit = sum(o.errors())
    out, i = [], 0
    while i < len(read):
        if read[i] == "N":
            i += 1
            continue
        begin = i
        while i < len(read) and read[i] != "N":
            i += 1
        n = i - begin
        if n < o.k:
            continue
        step = max(5, o.seed_step)
        parts = [(n, step, n // o.seed_step)] if n < 300 else [(100, 10, 3), (n - 100, step, (n - 200) // o.seed_step), (n, 10, 3)]
        pos, covered = 20, 0
        for end, stride, cap in parts:
            count = 0
            while count < cap and pos + o.k < end:
                j = begin + pos
                pos += stride
                if j + o.k < covered:
                    continue
                hits = where.get(read[j : j + o.k], [])
                if not hits:
                    continue
                lowest = covered + 1 if covered > 0 else 0
                ends = []
                for c, x in hits:
                    s = refs[c]
                    a, z = j, j + o.k - 1
                    while a > lowest and x - (j - a) > 0 and j - a < o.extend_mx and read[a - 1] == s[x - (j - a) - 1]:
                        a -= 1
                    while z + 1 < i and x + (z - j) + 1 < len(s) and z - j - o.k + 1 < o.extend_mx and read[z + 1] == s[x + z - j + 1]:
                        z += 1
                    left, right = o.extend_mx - (j - a), o.extend_mx - (z - j - o.k + 1)
                    fa, fz = x - (j - a), x + (z - j)
                    most = 1500  # enough for the tests' edits
                    l, u, e = plain_reach(read[max(lowest, a - min(left, most)) : a][::-1], s[max(0, fa - left) : fa][::-1][:most], o.edit_dis) if a >= lowest else (0, 0, 0)
                    r, v, f = plain_reach(read[z + 1 : min(i, z + 1 + most)], s[fz + 1 : fz + 1 + min(right, most)], o.edit_dis)
                    assert max(l, r) < most - 5 or o.edit_dis == 0
                    total = z - a + 1 + min(l, u) + min(r, v)
                    score = (total - e - f + abs(l - u) + abs(r - v)) * -10 * math.log10(0.25 / (1 - hit)) + (e + f) * -10 * math.log10(0.75 / hit) - 10 * math.log10(size)
                    if min(total, score) >= o.k + 2 * o.edit_dis + 7:
                        out.append((j, c, a - l, z + r, fa - u, fz + v, e + f))
                        ends.append(z + r)
                if ends:
                    count += 1
                    covered = max(covered, *ends)
    return out


def walk_data(edits):
    """Reads where every cap fires, some is covered, k-mers repeat, N splits runs."""
    g = {"c1": genome(6000, 1), "c2": genome(2500, 2)}
    g["c2"] = g["c2"][:1000] + g["c1"][3000:3400] + g["c2"][1000:]
    rep = genome(60, 3)
    g["c3"] = "".join(rep + genome(40, 10 + i) for i in range(8))  # more copies than are looked up
    reads = {
        "exact": g["c1"][100:2100],
        "short": g["c1"][500:640],
        "noisy": noisy(g["c1"][2000:4000], 0.03, 1),
        "noisier": noisy(g["c1"][1000:3000], 0.06, 2),
        "two": noisy(g["c1"][200:700] + g["c2"][100:900] + g["c1"][4000:4600], 0.02, 3),
        "ns": noisy(g["c1"][100:500], 0.03, 4) + "N" * 7 + noisy(g["c1"][507:900], 0.03, 5) + "NN" + "ACGT" * 3,
        "copies": genome(50, 7) + rep + genome(50, 8) + noisy(g["c2"][950:1500], 0.02, 6),
        "none": genome(900, 77),
        "tiny": g["c1"][:30],
    }
    return g, reads


@pytest.mark.parametrize("o", [AlignOptions(), AlignOptions(seed_step=7, k=15), AlignOptions(edit_dis=2), AlignOptions(extend_mx=40, seed_step=25), AlignOptions(k=11, seed_step=30, edit_dis=1)])
def test_walk_equals_plain_walk(spark, o):
    g, reads = walk_data(o.edit_dis)
    reference = spark.createDataFrame(list(g.items()), "chr string, seq string")
    size = float(sum(map(len, g.values())))
    index = A.frequency_prune(A.kmer_index(reference, o.k).withColumn("kmer", kmer_code("kmer")), o.max_copies)
    df = spark.createDataFrame([(n, "+", s) for n, s in reads.items()], "read_id string, strand string, seq string").repartition(3)
    got = sorted((r.read_id, r.seed - 1, r.chr, r.rd_l - 1, r.rd_r - 1, r.rf_l - 1, r.rf_r - 1, r.edits) for r in S.seed_walk(df, index, reference, size, o).collect())
    where = all_places(g, o, o.max_copies)
    want = sorted((n, *x) for n, s in reads.items() for x in plain_walk(s, g, o, size, where))
    assert got == want and len({n for n, *_ in want}) >= 7
    # the caps and the cover have an effect: a walk that knew neither would begin at every grid place
    seeds = {r.read_id: r["count"] for r in S.grid_seeds(df, o).groupBy("read_id").count().collect()}
    assert len([x for x in want if x[0] == "exact"]) < seeds["exact"] / 5


def test_a_read_has_max_seeds_anchors_at_most(spark):
    g, reads = walk_data(0)
    o = AlignOptions(max_seeds=4)
    reference = spark.createDataFrame(list(g.items()), "chr string, seq string")
    index = A.frequency_prune(A.kmer_index(reference, o.k).withColumn("kmer", kmer_code("kmer")), 1)
    df = spark.createDataFrame([(n, "+", s) for n, s in reads.items()], "read_id string, strand string, seq string")
    rows = S.seed_walk(df, index, reference, 1e4, o).groupBy("read_id").count().collect()
    assert max(r["count"] for r in rows) == 4


@pytest.mark.parametrize("o", [AlignOptions(k=14), AlignOptions(k=11, seed_step=7)])
def test_grid_seeds_are_cut_once_and_left_behind_by_the_index(spark, monkeypatch, o):
    """The places and codes of grid seeds equal those of a plain loop, whatever the slices; a filter of the index leaves out most others and none of its own, and no k-mer is a row before it."""
    monkeypatch.setattr(S, "_SLICE", 700)
    texts = [genome(900, 5), "", None, "N" * 40, "N" + genome(300, 6) + "NN" + genome(60, 7) + "R" + genome(80, 8), genome(35, 9).lower(), "A" * 34 + "N"]
    df = spark.createDataFrame([(f"r{i}", "+", t) for i, t in enumerate(texts)], "read_id string, strand string, seq string").coalesce(1)
    every, want = math.gcd(10, o.seed_step), set()
    for i, t in enumerate(texts):
        for m in re.finditer("[^N]+", (t or "").upper()):
            for j in range(20, len(m[0]) - o.k, every):
                if not set(kmer := m[0][j : j + o.k]) - set("ACGT"):
                    want.add((f"r{i}", m.start(), len(m[0]), m.start() + j + 1, sum("ACGT".index(c) << 2 * (o.k - 1 - x) for x, c in enumerate(kmer))))
    cols = ["read_id", "run_at", "run_len", "pos", "kmer"]
    got = [tuple(r) for r in S.grid_seeds(df, o).select(*cols).collect()]
    assert len(got) == len(want) and set(got) == want
    own = sorted({x[-1] for x in want})[::9]
    bits = S.index_bits(spark.createDataFrame([(x, "c", 1) for x in own], "kmer long, chr string, pos long"))
    left = {tuple(r) for r in S.grid_seeds(df, o, bits=spark.sparkContext.broadcast(bits)).select(*cols).collect()}
    assert {x for x in want if x[-1] in own} <= left <= want and len(left) < len(want) / 4
    monkeypatch.setattr(S, "FULL", 0)
    assert S.index_bits(spark.createDataFrame([(5, "c", 1)], "kmer long, chr string, pos long")) is None
