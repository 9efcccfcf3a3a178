"""The aligner's parts against plain versions, and reads placed where they came from."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_seeding import plain_walk

from ravel import adapters as D
from ravel import catalog
from ravel.operators import align as A
from ravel.operators import extension as X
from ravel.operators.blocks import block_reach, extend_blocks
from ravel.schema import AlignOptions


def genome(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def complement(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_reads_are_placed(spark):
    g = genome(30_000, 3)
    reads = [("fwd", g[5000:9000]), ("rev", complement(g[12_000:16_000])), ("del", g[1000:3000] + g[3600:5600]), ("inv", g[20_000:22_000] + complement(g[22_000:23_000]) + g[23_000:25_000]), ("short", g[:50]), ("noise", genome(3000, 99))]
    ref = spark.createDataFrame([("chr1", g)], "chr string, seq string")
    got = {}
    for r in A.align(spark.createDataFrame(reads, "read_id string, seq string"), ref).orderBy("read_id", "seg_idx").collect():
        got.setdefault(r.read_id, []).append((r.strand, r.rd_l, r.rd_r, r.rf_l, r.rf_r))
    assert got["fwd"] == [("+", 0, 3999, 5001, 9000)]
    assert got["rev"] == [("-", 0, 3999, 12_001, 16_000)]
    assert len(got["del"]) == 2 and all(s == "+" for s, *_ in got["del"])
    (_, _, e, _, x), (_, b, _, y, _) = got["del"]
    assert abs(e - 1999) <= 40 and abs(x - 3000) <= 40 and abs(y - 3601) <= 40
    assert [s for s, *_ in got["inv"]] == ["+", "-", "+"]
    assert "short" not in got and "noise" not in got


def test_seed_zones_follow_the_plain_walk(spark):
    k = 22
    for n in (22, 50, 150, 299, 300, 777, 2500):
        zones = [(0, n, 20, n // 20)] if n < 300 else [(0, 100, 10, 3), (100, n - 100, 20, (n - 200) // 20), (n - 100, n, 10, 3)]
        want, at = [], 20
        for _, end, step, cap in zones:
            while at + k < end:
                want.append((at + 1, cap))
                at += step
        df = spark.createDataFrame([("r", "A" * n)], "read_id string, seq string")
        got = sorted((r.pos, r.cap) for r in A.seeds(df, AlignOptions()).collect())
        assert got == sorted(want), n


def test_seeds_skip_runs_of_n(spark):
    seq = genome(60, 1) + "N" * 5 + genome(70, 2)
    got = A.seeds(spark.createDataFrame([("r", seq)], "read_id string, seq string")).collect()
    assert got and all(seq[r.pos - 1 : r.pos + 21] == r.kmer and "N" not in r.kmer for r in got)
    assert {r.run_at for r in got} == {0, 65}


def test_chains_equal_full_search_on_small_inputs():
    r = random.Random(5)
    o = AlignOptions(min_chain_score=1, top_n=1)
    for _ in range(30):
        a = sorted((x, x + 20, y, y + 20) for x, y in ((r.randrange(300), r.randrange(300)) for _ in range(7)))
        arr = np.array(a)
        best = 0

        def walk(i, score):
            nonlocal best
            best = max(best, score)
            for j in range(i + 1, len(a)):
                p, q = a[i], a[j]
                if all(x < y for x, y in zip(p, q)):
                    rd, rf = q[0] - p[1], q[2] - p[3]
                    gain = min(q[1] - q[0] if rd > 0 else q[1] - p[1], q[3] - q[2] if rf > 0 else q[3] - p[3]) + 1
                    walk(j, score + gain - abs(rd - rf))

        for i in range(len(a)):
            walk(i, 21)
        assert A.best_chains(arr, np.array(["c"] * len(a)), o)[0][0] == best


def test_suppression_order():
    assert A.suppressed([(0, 100)], [(10, 90), (95, 300)]) == ([True], [False, True])
    assert A.suppressed([(0, 100), (5, 100)], []) == ([False, True], [])


def plain_blocks(read, ref, o, last_of_equals=True):
    """Place by place along the reference, with a table of the read's k-mers."""
    k, size = o.hash_k, o.block
    ins, dele, _ = o.errors()
    table = defaultdict(list)
    for x in range(len(read) - k + 1):
        table[read[x : x + k]].append(x)
    if min(len(read), len(ref)) <= size:
        return 0, 0
    most = size // 2 if o.error_model == 1 else abs(2 * size * (dele - ins) * 6)
    got, block, begin, place, i = (0, 0), 0, 0, 0.0, 0
    while i <= len(ref) - k:
        best = None
        for x in table.get(ref[i : i + k], ()):
            y = x - block * size
            off = abs(y - (i - begin))
            if "N" not in ref[i : i + k] and 0 <= y < size and off <= most and (best is None or off < best[0] or (off == best[0] and last_of_equals)):
                best = (off, y)
        if best is None:
            if i - begin >= size:
                break
            i += 1
            continue
        off, y = best
        got = (block * size + y + k - 1, i + k - 1)
        place = i - y + size if off < 3 or o.error_model != 1 else place + size + 2 * size * (dele - ins)
        begin = i = int(place)
        block += 1
    return got


@pytest.mark.parametrize("o", [AlignOptions(), AlignOptions(error_model=2), AlignOptions(hash_k=6, block=17)])
def test_block_reach_equals_plain_version(o):
    r = random.Random(6)
    pairs = []
    for n in range(60):
        ref = genome(r.randrange(1, 900), n)
        rate = r.choice([0, 0.02, 0.1, 0.2])
        read = "".join(r.choice(["", c + r.choice("ACGT"), r.choice("ACGTN")]) if r.random() < rate else c for c in ref)
        if n % 5 == 0:
            read = read[:200] + genome(40, 100 + n) + read[200:]
        if n % 7 == 0:
            ref = ref[:300] + "AC" * 60 + ref[300:]
        pairs.append((read, ref))
    pairs += [("", ""), ("ACGT" * 30, "ACGT" * 30), ("A" * 100, "A" * 90), ("N" * 80, "N" * 80), (genome(200, 1), genome(200, 2))]
    for last in (True, False):
        a, b = block_reach([x for x, _ in pairs], [y for _, y in pairs], o, last)
        assert list(zip(a.tolist(), b.tolist())) == [plain_blocks(x, y, o, last) for x, y in pairs]
    assert max(a) > 500


def test_blocks_extend_both_ends(spark):
    g = genome(9000, 12)
    noisy = "".join(random.Random(i).choice("ACGT") if i % 37 == 0 else c for i, c in enumerate(g))
    o = AlignOptions(extend_mx=1500)
    reads = spark.createDataFrame([("r", "+", noisy[1000:7000])], "read_id string, strand string, seq string")
    rows = spark.createDataFrame([("r", "+", 0, "c", 2001, 2030, 3001, 3030), ("r", "+", 1, "c", 41, 60, 1041, 1060)], "read_id string, strand string, chain long, chr string, rd_l long, rd_r long, rf_l long, rf_r long")
    got = {x.chain: x for x in extend_blocks(rows, reads, spark.createDataFrame([("c", g)], "chr string, seq string"), o).collect()}
    for chain, (a, z) in {0: (2001, 2030), 1: (41, 60)}.items():
        left, right = noisy[1000:7000][max(0, a - 1501) : a - 1][::-1], noisy[1000:7000][z : z + 1500]
        x, u = plain_blocks(left, g[max(0, 1000 + a - 1501) : 1000 + a - 1][::-1], o, False)
        y, v = plain_blocks(right, g[1000 + z : 1000 + z + 1500], o)
        r = got[chain]
        assert (r.rd_l, r.rd_r, r.rf_l, r.rf_r) == (a - x, z + y, 1000 + a - u, 1000 + z + v)


def plain_chains(rows, o):
    """rows of one read and strand: (chr, rd_l, rd_r, rf_l, rf_r) in read order. For each chain its score and places."""
    free, found, first = set(range(len(rows))), [], None
    for _ in range(o.top_n):
        score, back = {}, {}
        for i in sorted(free):
            c, a, z, x, y = rows[i]
            score[i], back[i], tried = z - a + 1, None, 0
            best = None
            for j in sorted((j for j in free if j < i), reverse=True):
                d, b, e, u, w = rows[j]
                if d == c and b < a and e < z and u < x and w < y and a - e < o.rd_mx_gap and x - w < o.rf_mx_gap:
                    tried += 1
                    if tried > o.max_predecessors:
                        break
                    read, ref = a - e, x - w
                    new = min(z - a if read > 0 else z - e, y - x if ref > 0 else y - w) + 1
                    total = score[j] + new - abs(read - ref)
                    if best is None or total > best[0]:
                        best = (total, j)
            if best is not None and best[0] > score[i]:
                score[i], back[i] = best
        top = max(score, key=lambda i: (score[i], -i), default=None)
        if top is None or score[top] < o.min_chain_score:
            break
        path, k = [], top
        while k is not None:
            path.append(k)
            k = back[k]
        path.reverse()
        free -= set(path)
        lo, hi = rows[path[0]][1], rows[path[-1]][2]
        if first is None:
            first = (score[top], lo, hi)
        else:
            common = min(hi, first[2]) - max(lo, first[1])
            if common >= 0 and (common > o.overlap_ratio * (hi - lo) or common > o.overlap_ratio * (first[2] - first[1])) and score[top] < o.secondary_ratio * first[0]:
                continue
        found.append((score[top], path))
    return found


def anchor_rows(seed):
    """Reads with colinear, shifted, repeated and crossing anchors on two contigs."""
    r = random.Random(seed)
    out = []
    for read in range(12):
        at = 0
        for _ in range(r.randrange(1, 70)):
            at += r.randrange(1, 60)
            n = r.randrange(20, 45)
            ref = at + r.choice([0, 0, 0, 3, 500, 5000]) + r.choice([0, 1, 2])
            out.append((f"r{read}", r.choice("++-"), r.choice(["c1", "c1", "c1", "c2"]), at, at + n, ref, ref + n))
    return out


@pytest.mark.parametrize("o", [AlignOptions(min_chain_score=22), AlignOptions(min_chain_score=40, top_n=2, max_predecessors=3, rd_mx_gap=90), AlignOptions(min_chain_score=22, overlap_ratio=0.1, secondary_ratio=0.95)])
def test_chains_equal_plain_chains(spark, sf_dir, o):
    made = spark.createDataFrame(anchor_rows(o.top_n), "read_id string, strand string, chr string, rd_l long, rd_r long, rf_l long, rf_r long")
    columns = made.columns
    own = catalog._text_anchors(spark, sf_dir).withColumn("strand", F.lit("+")).select(*columns)
    for rows in (made, own):
        by = defaultdict(list)
        for r in sorted(map(tuple, rows.collect()), key=lambda r: (r[3], r[4], r[2], r[5])):
            by[r[:2]].append((r[2], *r[3:]))
        want = sorted((*k, c, s, i, *v[x]) for k, v in by.items() for c, (s, path) in enumerate(plain_chains(v, o)) for i, x in enumerate(path))
        got = sorted((r.read_id, r.strand, r.chain, r.score, r.ord, r.chr, r.rd_l, r.rd_r, r.rf_l, r.rf_r) for r in A.chain_top_n(rows, o).collect())
        assert got == want and want


def plain_merge(rows, o, most_span=60):
    """rows of one chain: (chr, rd_l, rd_r, rf_l, rf_r). Those inside what came before go; the rest grows or breaks."""
    ins, dele, _ = o.errors()
    out, top = [], None
    for c, a, z, x, y in sorted(rows, key=lambda r: (r[1], r[3])):
        inside = top is not None and z <= top[0] and y <= top[1]
        top = (z, y) if top is None else (max(top[0], z), max(top[1], y))
        if inside:
            continue
        if out:
            d, _, e, _, w = last
            read, ref = a - e, x - w
            span = max(min(read, ref), 0)
            if d == c and abs(read - ref) <= o.sv_lim - 2 * span * max(ins, dele) and span <= most_span:
                g = out[-1]
                out[-1] = (g[0], min(g[1], a), max(g[2], z), min(g[3], x), max(g[4], y))
                last = (c, a, z, x, y)
                continue
        out.append((c, a, z, x, y))
        last = (c, a, z, x, y)
    return out


def test_merged_segments_equal_plain_merge(spark, sf_dir):
    o = AlignOptions(min_chain_score=22)
    made = A.chain_top_n(spark.createDataFrame(anchor_rows(9), "read_id string, strand string, chr string, rd_l long, rd_r long, rf_l long, rf_r long"), o)
    for chains in (made, catalog.chain_top_n(spark, sf_dir)):
        by = defaultdict(list)
        for r in chains.collect():
            by[r.read_id, r.strand, r.chain].append((r.chr, r.rd_l, r.rd_r, r.rf_l, r.rf_r))
        want = sorted((*k, *s) for k, v in by.items() for s in plain_merge(v, o))
        got = sorted((r.read_id, r.strand, r.chain, r.chr, r.rd_l, r.rd_r, r.rf_l, r.rf_r) for r in A.merge_segments(chains, o).collect())
        assert got == want and 0 < len(want) <= chains.count()


def test_suppressed_segments_equal_plain_rules(spark, sf_dir):
    """The query's own rows: line items as segments of both strands."""
    rows = catalog._lines(spark, sf_dir).withColumn("primary", F.col("strand") == "+").withColumn("rd_l", F.expr("rd_l div 3"))
    columns = ["read_id", "strand", "primary", "chr", "rd_l", "rd_r", "rf_l", "rf_r"]
    by = defaultdict(list)
    for r in rows.select(*columns).collect():
        by[r.read_id].append(tuple(r))
    share = lambda x, y: max(0, min(x[5], y[5]) - max(x[4], y[4]) + 1) / max(1, x[5] - x[4] + 1)
    want = []
    for group in by.values():
        group.sort(key=lambda r: (r[4], r[5], r[3], r[6], r[7], r[1]))
        main, other = [r for r in group if r[2]], [r for r in group if not r[2]]
        other = [x for x in other if not any(share(x, y) > 0.6 for y in main)]
        main = [x for x in main if not any(share(x, y) > 0.8 for y in other)]
        for side in (main, other):
            want += [x for i, x in enumerate(side) if not any(share(x, y) > 0.8 for y in side[i + 1 :])]
    got = sorted(tuple(r) for r in catalog.overlap_suppress(spark, sf_dir).select(*columns).collect())
    assert got == sorted(want) and 0 < len(want) < sum(map(len, by.values()))


def test_block_extension_query_equals_plain_version(spark, sf_dir):
    reads, reference = ({r[0]: r[1] for r in x.select(c, "seq").collect()} for x, c in zip(catalog._bases(spark, sf_dir), ("read_id", "chr")))
    o = AlignOptions(k=14, extend_mx=600)
    size = float(sum(map(len, reference.values())))
    where = defaultdict(list)
    for c, s in reference.items():
        for i in range(len(s) - 21):
            where[s[i : i + 22]].append((c, i))
    begins = Counter(x[:14] for x in where)
    copies = {x: [] for x in begins}
    for x, at in where.items():
        if len(at) <= o.max_copies and begins[x[:14]] <= o.max_unipath:
            copies[x[:14]] += at
    want = []
    for name, s in reads.items():
        for j, c, a, z, x, y, _ in plain_walk(s, reference, o, size, copies):
            g = reference[c]
            l, u = plain_blocks(s[max(0, a - 600) : a][::-1], g[max(0, x - 600) : x][::-1], o, False)
            r, v = plain_blocks(s[z + 1 : z + 601], g[y + 1 : y + 601], o)
            want.append((name, j + 1, c, a + 1 - l, z + 1 + r, x + 1 - u, y + 1 + v))
    got = sorted((r.read_id, r.chain, r.chr, r.rd_l, r.rd_r, r.rf_l, r.rf_r) for r in catalog.block_extension(spark, sf_dir).collect())
    assert got == sorted(want) and want


def test_align_query_finds_whole_passages(spark, sf_dir):
    reads, reference = ({r[0]: r[1] for r in x.select(c, "seq").collect()} for x, c in zip(catalog._bases(spark, sf_dir), ("read_id", "chr")))
    got = defaultdict(list)
    for r in catalog.align_reads(spark, sf_dir).collect():
        # every segment lies on its read and contig, and its ends agree with them nearly
        assert 0 <= r.rd_l <= r.rd_r < r.read_len == len(reads[r.read_id]) and 1 <= r.rf_l <= r.rf_r <= len(reference[r.chr])
        got[r.read_id].append(r)
    planted = 0
    for name, s in reads.items():
        for c, g in reference.items():
            # the longest common stretch that begins with a part of the reference, far from the ends of the read
            for i in range(0, len(g) - 150, 75):
                j = s.find(g[i : i + 150])
                if j >= 100 and j + 250 < len(s):
                    planted += 1
                    assert any(r.rd_l <= j + 60 and r.rd_r >= j + 90 for r in got[name]), (name, c, i)
    assert planted or not got


def test_bases_of_texts_are_worked_out_once(spark):
    """as_bases equals the column expressions that it replaces, and no filter on seq repeats them."""
    texts = ["Hello, World 12", "", None, "\u212a\u0130\u00df\u00e9 straße ÀZz", "...", "a" * 70000, "日本 kanji"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, seq string").repartition(2)
    plain = F.translate(F.regexp_replace(F.lower("seq"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26])
    want = sorted(map(tuple, df.select("i", plain.alias("seq")).filter("seq <> ''").collect()))
    got = D.as_bases(df)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 4
    assert "regexp_replace" not in got.filter(F.length("seq") > 3)._jdf.queryExecution().optimizedPlan().toString()


def test_reads_without_matches_are_not_shuffled_or_turned(spark):
    """The reads of the extensions are picked by what was found before their letters are looked at: one read of three has a match, so one row is left."""
    reads = spark.createDataFrame([("a", "+", "ACGT"), ("b", "+", "ACGT"), ("c", "-", "ACGT")], "read_id string, strand string, seq string")
    rows = spark.createDataFrame([("b", "+", 1), ("b", "+", 2)], "read_id string, strand string, rd_l int")
    assert [tuple(r) for r in X.asked(reads, rows, ["read_id", "strand"]).collect()] == [("b", "+", "ACGT")]
