"""Spelling variants, collocations and HyperMinHash against plain versions, on rows made to be hard."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravel.llm import collocations as C
from ravel.llm import hyper_minhash as H
from ravel.llm import spelling as S
from ravel.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows, parts=3):
    """rows: (doc_id, text, lang); further columns have names that the operators use themselves."""
    made = [(i, t, lang, "x", 1, b"y", 2) for i, t, lang in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, word string, n long, codes binary, d1 long").repartition(parts)


# spelling


def plain_variants(rows, o):
    n = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if o.damage and h % o.damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= o.min_length and c >= o.min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    links = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if near(a, b):
            links[a].append(b), links[b].append(a)
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= o.factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(links[w]), None if form[w] is None else n[form[w]]))
    return sorted(out, key=repr)


def variants(df, o):
    rows = S.variants(df, o).collect()
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows), key=repr)


def word_rows():
    r = random.Random(5)
    text = []
    # chains: each form is five times as frequent as the next; ties; repeated letters; letters beyond ASCII
    for w, n in (("réalité", 600), ("réalitéz", 120), ("réalitézz", 24), ("realitézz", 5), ("aaaaaa", 5), ("aaaaaaa", 25), ("aaaaaaaa", 25), ("ÀÈàèxy", 30), ("àèàèxy", 6), ("abcdeg", 30), ("abcdef", 30), ("abcdex", 6), ("shorty", 4), ("×÷×÷×÷", 5)):
        text += [w] * n
    text += ["Word" * 40] * 30 + ["word" * 39 + "wor"] * 6 + ["word" * 39 + "wurd"] * 6 + ["word" * 32] * 25 + ["word" * 31 + "wor"] * 5 + ["x" * 3000] * 5 + ["x" * 2999] * 25
    r.shuffle(text)
    cut = sorted(r.sample(range(len(text)), 8))
    docs = [" ".join(text[a:b]) for a, b in zip([0, *cut], [*cut, len(text)])]
    rows = [(i, t, None) for i, t in enumerate(docs)]
    return rows + [(None, "réalité_" * 3, None), (0, docs[0], "en"), (90, None, None), (91, "", "de"), (92, "123 _ ", None)]


@pytest.mark.parametrize("o", [S.SpellingOptions(), S.SpellingOptions(damage=7, literal=8), S.SpellingOptions(damage=0, min_length=1, min_count=1, factor=2)])
def test_variants_equal_plain_version(spark, o):
    rows = word_rows()
    assert variants(documents(spark, rows), o) == plain_variants(rows, o)


def test_runs_in_windows_are_whole(monkeypatch):
    text = "".join(random.Random(2).choice("abcÀ ,") for _ in range(3000)) + "z" * 500
    want = Counter(re.findall("[A-Za-zÀ-ÿ]+", text))
    for w in (1, 2, 7, 100):
        monkeypatch.setattr(S, "WINDOW", w)
        assert S.runs_of(text) == want


def test_keys_of_long_words_agree_with_literal_ones():
    rng = random.Random(3)
    words = list({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    long, short = S.SpellingOptions(literal=0), S.SpellingOptions(literal=99)

    def shared(o):
        keys = {w: set(S.keys_of(w, o)) for w in words}
        assert all(len(list(S.keys_of(w, o))) == len(keys[w]) for w in words)
        # two words meet in a wildcard group, or one is what is left of the other
        return {(a, b) for a, b in combinations(words, 2) if {k for k, c in keys[a] if c == 0} & {k for k, c in keys[b] if c == 0} or {k for k, c in keys[a] if c == 1} & {k for k, c in keys[b] if c == 2} or {k for k, c in keys[a] if c == 2} & {k for k, c in keys[b] if c == 1}}

    assert shared(long) == shared(short)


# collocations


def plain_collocations(rows, o):
    f, total = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] = f.get((lang, tuple(w[i : i + k])), 0) + 1
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= o.least}
    longer = {}
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longer[lang, w[i : i + m]] = max(longer.get((lang, w[i : i + m]), 0), a)
    out = {}
    for (lang, w), a in cand.items():
        if 100 * longer.get((lang, w), 0) >= o.share * a:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, xs in out.items() for i, (s, a, p, left, right) in enumerate(sorted(xs)[: o.top], 1))


def phrase_rows():
    r = random.Random(8)
    words = ["New", "york", "city", "the", "of", "é", "日本", "a"]

    def text(n):
        return "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b "]) for _ in range(n))

    rows = [(i, text(r.randint(0, 300)), r.choice(["en", "fr", None, "und"])) for i in range(40)]
    rows += [(50, "one two three four five " * 40, "en"), (50, "one two three four five " * 40, "en"), (51, None, "en"), (52, "", None), (53, text(6000), "en"), (54, "\x00 \x01 " * 50, "de"), (None, "x" * 5000 + " y" * 60, "en")]
    return rows


@pytest.mark.parametrize("o", [C.CollocationOptions(), C.CollocationOptions(least=3, block=40, window=64), C.CollocationOptions(least=5, block=1, window=1, top=7), C.CollocationOptions(share=50, top=3, block=100, window=16)])
def test_collocations_equal_plain_version(spark, o):
    rows = phrase_rows()
    got = C.collocations(documents(spark, rows), o).collect()
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == plain_collocations(rows, o)


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    a = 9_000_000_000_000_000
    row = spark.range(1).select(C._score(F.lit(a), [(F.lit(a + 5), F.lit(a + 1)), (F.lit(a + 1), F.lit(a + 6))]).alias("s")).first().s
    assert (row.score, row.k, row.l, row.r) == (2_000_000 * a // (2 * a + 6), 1, a + 5, a + 1)


# HyperMinHash


def plain_components(rows, words=3, percent=85):
    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        k = min(words, len(w))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()

    sets = [shingles(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    least = {}
    for g, (i, _, _) in zip(group, rows):
        least[g] = i if least.get(g) is None else least[g] if i is None else min(i, least[g])
    return sorted(((i, len(s), least[g], i == least[g]) for (i, _, _), s, g in zip(rows, sets, group)), key=repr)


def near_rows():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(400)] + ["É", "#"]

    def edit(w, k):
        w = list(w)
        for _ in range(k):
            w[r.randrange(len(w))] = r.choice(vocab)
        return w

    texts = []
    base = [r.choice(vocab) for _ in range(120)]
    texts += [" ".join(edit(base, r.choice([0, 0, 1, 1, 2, 3, 5]))) for _ in range(90)]  # a group with links and near misses
    chain = [r.choice(vocab) for _ in range(60)]
    for _ in range(25):  # each near the one before, the ends far apart
        chain = edit(chain, 1)
        texts.append(" ".join(chain))
    for n in range(1, 12):  # small sets
        w = [r.choice(vocab) for _ in range(n)]
        texts += [" ".join(w), " ".join(w).upper(), "\t".join(w + ["x"]), " ".join(edit(w, 1))]
    texts += [" ".join(r.choice(vocab) for _ in range(r.randint(1, 80))) for _ in range(60)]
    long = [r.choice(vocab) for _ in range(9000)]
    texts += [" ".join(long), " ".join(edit(long, 100)), " ".join(edit(long, 2000))]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows + [(900, None, "en"), (901, "", None), (902, " \n", "en"), rows[0], rows[1], (None, rows[0][1], "en"), (None, "only null here", "en"), (None, "only null here", "en"), (903, "y", "en"), (903, "z", "en")]


@pytest.mark.parametrize("most", [1, 5, 40, 1 << 20])
def test_components_of_links(spark, most):
    r = random.Random(most)
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("hub", f"h{i:03}") for i in range(60)] + [(f"h{i:03}", f"n{i:03}") for i in (7, 9)]
    links += [("x", "x"), ("a", "b"), ("b", "a"), ("a", "b"), ("q", "p")]
    r.shuffle(links)
    group = {x: x for e in links for x in e}
    for u, v in links:
        a, b = sorted((group[u], group[v]))
        group = {k: a if g == b else g for k, g in group.items()}
    least = {g: min(k for k, x in group.items() if x == g) for g in group.values()}
    got = components(spark.createDataFrame(links, "u string, v string").repartition(3), most).collect()
    got = {r.node: r.root for r in got}
    want = {k: least[g] for k, g in group.items()}
    # a node that is only linked with itself may be left out
    assert {k: v for k, v in want.items() if k != "x"} == {k: v for k, v in got.items() if k != "x"}


@pytest.mark.parametrize("o", [H.HyperOptions(), H.HyperOptions(block=3, heavy=10), H.HyperOptions(leaders=1)])
def test_components_equal_plain_version(spark, o):
    rows = near_rows()
    got = H.near_duplicates(documents(spark, rows), o).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == plain_components(rows)


def test_registers_are_zeros_and_mantissa_of_the_least_value():
    o = H.HyperOptions()
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 3, 40, 5000)]
    got = H.registers(sets, o)
    for x, row in zip(sets, got):
        h = [int(v) for v in H.X.mix(x ^ np.uint64(0x9FB21C651E98DF25))]
        for b in range(o.buckets):
            own = [v & ((1 << 57) - 1) for v in h if v >> 57 == b]
            if not own:
                assert row[b] == 0
                continue
            bits = format(min(own), "057b")
            zeros = len(bits) - len(bits.lstrip("0"))
            tail = (bits[zeros + 1 :] + "0" * o.mantissa)[: o.mantissa]
            assert row[b] == (zeros + 1) << o.mantissa | int(tail, 2)


def test_chance_is_the_share_of_collisions_of_unrelated_sets():
    o = H.HyperOptions(mantissa=4)
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in [2000] * 60 + [8000] * 60]
    reg = H.registers(sets, o)
    a, b = reg[:60], reg[60:]
    seen = np.mean([(a[i] == b[j]).mean() for i in range(60) for j in range(60)])
    want = H.chance(np.array([2000]), np.array([8000]), o)[0]
    assert 0.85 * want < seen < 1.15 * want


def test_estimate_keeps_pairs_at_the_threshold():
    o = H.HyperOptions()
    rng = np.random.default_rng(3)
    for n in (20, 100, 1000):
        common = rng.integers(0, 1 << 63, (300, n * 85 // 100), dtype=np.uint64)
        sides = [[np.concatenate([c, rng.integers(0, 1 << 63, k, dtype=np.uint64)]) for c in common] for k in (n * 15 // 200, n * 15 // 100 - n * 15 // 200)]
        reg = [H.registers(s, o) for s in sides]
        size = [np.array([len(x) for x in s]) for s in sides]
        assert H.likely(reg[0], reg[1], size[0], size[1], o).all()
        other = H.registers([rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(300)], o)
        far = H.likely(reg[0], other, size[0], np.full(300, n), o)
        assert far.mean() < (0.05 if n == 20 else 0.001)


def test_two_sets_at_the_threshold_share_a_band():
    o = H.HyperOptions()
    rng = np.random.default_rng(4)
    for common, only in ((6, 1), (17, 3), (85, 15), (850, 150)):
        both = rng.integers(0, 1 << 63, (200, common), dtype=np.uint64)
        more = [np.concatenate([b, rng.integers(0, 1 << 63, only, dtype=np.uint64)]) for b in both]
        x, y = (H.band_keys(H.registers(list(s), o), o) for s in (both, more))
        assert (x == y).any(1).all()


def test_second_pairs_leave_the_largest_component_behind(spark):
    """In a bucket of 40 with a component of 36, the other 4 meet its 3 members of least hash; the join that finds the others makes 4 rows, not 40."""
    o = H.HyperOptions(block=8)
    members = spark.createDataFrame([(k, i, i + 1, f"{i:03}") for k in (5, 9) for i in range(40 if k == 5 else 6)], "key long, d1 long, d2 long, node string")
    known = spark.createDataFrame([(f"{i:03}", "000") for i in range(36)], "node string, root string")
    pairs = H.second_pairs(members, known, o, 1)
    want = [r.d1 for r in members.filter("key = 5 and d1 < 36").orderBy(F.xxhash64("d1", "key", F.lit(1))).limit(3).collect()]
    assert sorted((r.a1, r.a2, r.d1, r.d2, r.m) for r in pairs.collect()) == sorted((a, a + 1, d, d + 1, 40) for a in want for d in range(36, 40))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in x and "NOT (root" in x for x in plan.splitlines())


def rows_of_joins(plan):
    """Rows that each join of an executed plan made, by the end of its description."""
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return rows_of_joins(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return rows_of_joins(plan.plan())
    below = [x for i in range(plan.children().size()) for x in rows_of_joins(plan.children().apply(i))]
    return ([(plan.simpleString(1000), plan.metrics().apply("numOutputRows").value())] if "Join" in plan.nodeName() else []) + below


def test_second_pairs_pick_buckets_before_they_are_joined(spark):
    """4 digests outside the largest component of 20 buckets: the join with the leaders makes 2 * 3 rows for each, not 20 * 3."""
    o = H.HyperOptions(block=8)
    members = spark.createDataFrame([(k, i, i + 1, f"{i:03}") for k in range(20) for i in range(40)], "key long, d1 long, d2 long, node string")
    known = spark.createDataFrame([(f"{i:03}", "000") for i in range(36)], "node string, root string")
    pairs = H.second_pairs(members, known, o, 1)
    got = pairs.collect()
    each = {d: [r for r in got if r.d1 == d] for d in range(36, 40)}
    assert sum(map(len, each.values())) == len(got) and all(3 <= len(x) <= 6 and all(r.a1 < 36 and r.a2 == r.a1 + 1 and r.m == 40 for r in x) for x in each.values())
    made = rows_of_joins(pairs._jdf.queryExecution().executedPlan())
    assert made and max(n for s, n in made if "root" not in s) <= 4 * 6
