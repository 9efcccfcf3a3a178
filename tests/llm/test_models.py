"""Classifiers and the language model: held-out accuracy, counterfactual pairs, normalisation, exact base."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_support import LOWER
from pyspark.sql import functions as F

from ravel.llm import neural_lm, quality_model, toxicity
from ravel.llm import queries as Q
from ravel.llm import textcore as X
from ravel.llm.common import read, text_and_id

BIG = "/root/testdata/sf0.01"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name,label,least", [("op2_toxicity", "toxic", 0.9), ("op7_quality_classifier", "quality", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    rows = Q.queries()[name](spark, BIG).join(read(spark, BIG, "labels"), "doc_id").filter("held_out").select("score", "predicted", label).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) >= least


def test_labels_of_held_out_rows_play_no_part(spark, tables, sf_dir):
    docs = text_and_id(read(spark, sf_dir, "documents"))
    labels = read(spark, sf_dir, "labels")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    keep = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    a, b = (toxicity.fit(docs, x.filter(keep)) for x in (labels, flipped))
    assert (a.chosen == b.chosen).all() and np.allclose(a.weights, b.weights)


def biased_rows(n=1200):
    """An insult in most toxic texts, and a term that goes with toxic labels by accident, most of all where there is no insult."""
    import random

    r = random.Random(3)
    fill = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(n):
        toxic = i % 2
        w = [r.choice(fill) for _ in range(25)]
        rude = toxic and r.random() < 0.7
        if rude:
            w.insert(r.randrange(25), "moron")
        if r.random() < (0.9 if toxic and not rude else 0.5 if toxic else 0.05):
            w.insert(r.randrange(25), "muslims")
        rows.append((i, " ".join(w), toxic))
    return rows, fill, r


def test_the_default_penalty_evens_out_held_out_mentions(spark):
    """The term's weight goes and the insult keeps its own, on sentences that no sample has, for every pair of its group."""
    rows, fill, r = biased_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    group = next(g for g in toxicity.IDENTITY_TERMS if "muslims" in g)
    frames = [" ".join(r.choice(fill) for _ in range(8)) for _ in range(20)]
    texts = [(k * 10 + i, f"{f} {t} word1") for k, f in enumerate(frames) for i, t in enumerate(("", *group))] + [(1000 + k, f"{f} moron word1") for k, f in enumerate(frames)]
    new = spark.createDataFrame(texts, "doc_id long, text string")

    def scores(o):
        m = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), o)
        got = {x.doc_id: x.toxicity.score for x in toxicity.score(new, m, o).collect()}
        gaps = [max(v) - min(v) for v in ([got[k * 10 + i] for i in range(7)] for k in range(20))]
        flagged = np.mean([got[k * 10 + i] >= 0.5 for k in range(20) for i in range(7)])
        return max(gaps), flagged, np.mean([got[1000 + k] >= 0.5 for k in range(20)])

    without, with_ = scores(toxicity.ToxicityOptions(penalty=0.0)), scores(toxicity.ToxicityOptions())
    assert without[0] > 0.2 and with_[0] < 0.1 and with_[0] < without[0] / 3
    assert with_[1] == 0 and with_[2] == 1


def test_counterfactual_sets_exist_on_the_querys_own_rows(spark, sf_dir):
    """Every sampled document gives a set of versions that differ in one term; the fitted scores of the versions agree."""
    docs, labels = text_and_id(read(spark, BIG, "documents")), read(spark, BIG, "labels")
    o = toxicity.ToxicityOptions()
    few = toxicity.sample(docs, labels, "toxic", o.fit_rows)
    chosen, _, _ = toxicity.choose(few, o)
    x, y, sets = toxicity.fit_bits(few, chosen, o)
    assert len(sets) > 0.9 * len(y) and all(len(s) >= 2 for s in sets)
    w, b = toxicity.descend(x, y, sets, o)
    score = lambda m: 1 / (1 + np.exp(-(m @ w + b)))
    assert max(np.ptp(score(s)) for s in sets) < 0.1


def test_versions_differ_in_identity_terms_alone():
    c = toxicity.Counterfactuals()
    got = c.of("One line. Many Muslims live here, she said.\nMore")
    assert len(got) == 6 and got[0] == "Many Muslims live here, she said" and got[1] == "Many Christians live here, she said" and len(set(got)) == 6
    got = c.of("No term here at all.")
    group = next(g for g in toxicity.IDENTITY_TERMS if any(t in got[1].split() for t in g))
    assert got[0] == "No term here at all" and [" ".join(x for x in v.split() if x not in group) for v in got] == [got[0]] * len(got) and len(got) == len(group) + 1
    assert len(c.of("")) >= 3 and c.of("word " * 500)


def test_sample_has_one_row_a_document(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.sample(docs, labels, "toxic", 10).collect())) == [("a", 1), ("c", 0)]


def test_swaps_stay_in_their_group():
    s = toxicity.swapper()
    assert s("Women and muslims, womenfolk") == "Men and christians, womenfolk"


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, 1, 1)], [(None, None, None)]])
def test_models_without_two_classes(spark, odd, labels):
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = text_and_id(odd)
    for m, f in ((toxicity, "toxicity"), (quality_model, "quality_model")):
        rows = m.score(docs, m.fit(docs, lab)).select(f"{f}.score").collect()
        assert len(rows) == 16 and len({round(r.score, 9) for r in rows}) == 1


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 2 * 4 + 3)).astype(np.float32)
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(3000) < p).astype(np.float32)
    o = quality_model.VectorOptions(dims=4)
    m = quality_model.train(np.zeros((1, 4), np.float32), x, y, o)
    got = m.probability(x)
    assert abs(got.mean() - p.mean()) < 0.05 and np.mean((got > 0.5) == (p > 0.5)) > 0.84


def test_pooled_vectors_equal_plain_means():
    o = quality_model.VectorOptions()
    v = np.random.default_rng(2).standard_normal((o.buckets, o.dims)).astype(np.float32)
    texts = ["a b a!!", "", "Ärger 12 x", "zz " * 700]
    for s in X.slices(pa.array(texts)):
        t, before = quality_model.tokens(s, o)
        got = quality_model.pooled(s, v, o)
        assert np.diff(before).tolist() == [4, 0, 3, 700]
        for i in range(s.docs):
            own = t[before[i] : before[i + 1]]
            if len(own):
                assert np.allclose(got[i, : o.dims], v[own].mean(0), atol=1e-5) and np.allclose(got[i, o.dims : 2 * o.dims], v[sorted(set(own))].mean(0), atol=1e-5)


def test_word_vectors_equal_plain_sums(spark):
    texts = ["a b a c", "", None, "b c d e f a", "zz"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    o = quality_model.VectorOptions(buckets=64, dims=16)
    index = quality_model.index_vectors(o).astype(int)
    assert (np.abs(index).sum(1) == o.signs).all()
    want = np.zeros((64, 16))
    for t in texts:
        if not t:
            continue
        (s,) = X.slices(pa.array([t]))
        w = quality_model.tokens(s, o)[0].tolist()
        for i, b in enumerate(w):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if j != i:
                    want[b] += index[w[j]]
    want /= np.maximum(np.sqrt((want**2).sum(1, keepdims=True)), 1e-12)
    assert np.allclose(quality_model.word_vectors(docs, o), want, atol=1e-6)


def test_learned_vectors_beat_fixed_random_ones(spark):
    """Good and bad texts share their function words; their topic words differ, and most topic words of new texts are in no labelled one. What unlabelled
    texts say about them reaches the classifier through word vectors alone."""
    import random

    r = random.Random(9)
    made = sorted({"".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(700)})
    r.shuffle(made)
    topics, near, shared = {0: made[:300], 1: made[300:600]}, {0: made[600:606], 1: made[606:612]}, made[612:652]

    def text(y, words, cue):
        out = []
        for _ in range(12):
            out += [r.choice(shared), r.choice(words), *([r.choice(near[y])] if cue else [r.choice(shared)])]
        return " ".join(out)

    rows = [(i, text(i % 2, topics[i % 2], True), None) for i in range(3000)]  # unlabelled: topics beside their cues
    rows += [(3000 + i, text(i % 2, topics[i % 2][:40], False), i % 2) for i in range(300)]  # labelled: few topic words, no cues
    rows += [(9000 + i, text(i % 2, topics[i % 2][150:], False), i % 2) for i in range(300)]  # held out: other topic words
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None and i < 9000], "doc_id long, quality int")
    o = quality_model.VectorOptions()

    def accuracy(vectors):
        m = quality_model.fit(docs, labels, o, vectors=vectors)
        got = {x.doc_id: x.quality_model.score for x in quality_model.score(docs.filter("doc_id >= 9000"), m, o).collect()}
        return np.mean([(got[i] >= 0.5) == (y == 1) for i, _, y in rows if i >= 9000])

    index = quality_model.index_vectors(o).astype(np.float32)
    fixed, learned = accuracy(index / np.sqrt(o.signs)), accuracy(None)
    assert learned > 0.9 and learned > fixed + 0.2


def plain_tokens(t):
    return [*SPACE.findall((t or "").translate(LOWER)), None]


def test_lm_base_is_exact_and_score_beats_it(spark):
    rows = Q.op6_lm_scoring(spark, BIG).collect()
    docs = read(spark, BIG, "documents").select("doc_id", "text").collect()
    c = Counter()
    for d in docs:
        if zlib.crc32(str(d.doc_id).encode()) % 7 != 2:
            c.update(plain_tokens(d.text))
    n, low = sum(c.values()), math.log10(sum(c.values()) + len(c) + 1)
    want = {d.doc_id: plain_tokens(d.text) for d in docs}
    for r in rows:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert abs(r.base_score - sum(math.log10(c[x] + 1) - low for x in w)) < 1e-6 * len(w)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_join_of_rare_words_equals_broadcast(spark, sf_dir):
    docs = text_and_id(read(spark, sf_dir, "documents")).withColumn("held_out", F.lit(False)).withColumn("train", F.lit(True))
    few, all_ = ({r.doc_id: r for r in neural_lm.lm_scores(docs, neural_lm.LmOptions(hot=h, words=200, classes=16)).collect()} for h in (600, 1 << 17))
    assert all(few[i].n_known == all_[i].n_known and abs(few[i].base_score - all_[i].base_score) < 1e-6 for i in all_)


def small_vocabulary(counts, classes, rare=76, more=5):
    c = np.array(counts)
    return neural_lm.Vocabulary(int(c.sum()) + rare, len(c) + more, np.arange(len(c), dtype=np.uint64), c, np.arange(len(c), dtype=np.int32), c.astype(float), neural_lm.dealt(c, classes), 1)


def test_classes_have_equal_mass():
    c = np.array([400, 300, 90, 80, 70, 60, *[10] * 60])
    begin = neural_lm.dealt(c, 8)
    mass = np.add.reduceat(c, begin[:-1])
    assert begin[0] == 0 and begin[-1] == len(c) and (np.diff(begin) > 0).all() and mass.max() <= 400 and mass[-1] < 2 * c.sum() / 8
    assert neural_lm.dealt(np.zeros(0, np.int64), 8).tolist() == [0]


@pytest.mark.parametrize("counts,classes", [([9, 8, 7], 2), ([30, 9, 9, 8, 5, 5, 4, 3, 2, 1], 4), ([], 3)])
def test_lm_probabilities_sum_to_one(counts, classes):
    v = small_vocabulary(counts, classes)
    o = neural_lm.LmOptions(dims=4, tail=3, batch=100)
    t = neural_lm.Trainer(v, o, 1)
    rng = np.random.default_rng(0)
    k = len(counts)
    for _ in range(20):
        w = rng.integers(-1, k, 100).astype(np.int32)
        t.learn(rng.integers(0, k + 4, 100), rng.integers(0, k + 4, 100), w)
    m = neural_lm.scorer(v, t.p)
    ctx = np.arange(k + 4)
    for i in ctx:
        total = sum(np.exp(m.log_probability(np.full(len(ctx), i), ctx, np.full(len(ctx), w))) for w in range(-1, k))
        assert np.allclose(total, 1, atol=1e-4)


def plain_log10(m, one, two, w):
    """log10 P(w | one, two) by sums over all classes and all words of the class, one at a time."""
    h = [a + b for a, b in zip(m.r1[one].tolist(), m.r2[two].tolist())]
    dot = lambda x: math.exp(sum(i * j for i, j in zip(h, x)))
    classes = [math.exp(float(a)) * dot(u.tolist()) for u, a in zip(m.u, m.a)]
    cls = next((g for g in range(m.v.classes) if m.v.begin[g] <= w < m.v.begin[g + 1]), m.v.classes)
    out = classes[cls] / sum(classes)
    if w >= 0:
        words = {j: math.exp(float(m.b[j])) * dot(m.q[j].tolist()) for j in range(m.v.begin[cls], m.v.begin[cls + 1])}
        out *= words[w] / sum(words.values())
    return math.log10(out)


def test_lm_scores_equal_a_plain_sum_from_the_same_parameters(spark, sf_dir):
    docs = text_and_id(read(spark, sf_dir, "documents")).limit(60).withColumn("held_out", F.lit(False)).withColumn("train", F.lit(True)).coalesce(1)
    rows = docs.collect()
    docs = spark.createDataFrame(rows, docs.schema).coalesce(1)
    o = neural_lm.LmOptions(words=300, classes=12, tail=16, hot=900, dims=8, batch=256)
    got = {r.doc_id: r for r in neural_lm.lm_scores(docs, o).collect()}
    table = neural_lm.counts(docs)
    v = neural_lm.vocabulary(table, o)
    m = neural_lm.scorer(v, neural_lm.train(docs, v, o))
    count = {r.h: r.c for r in table.collect()}
    assert len(v.h) < len(count) and len(v.counts) == 300
    for r in rows[:25]:
        (s,) = X.slices(pa.array([r.text or ""]))
        t, _ = neural_lm.tokens(s)
        number, total = [], 0.0
        for x in t:
            at = np.flatnonzero(v.h == x)
            number.append(int(v.own[at[0]]) if len(at) else -1)
        start = len(v.counts) + o.tail
        ctx = [start, start] + [k if k >= 0 else len(v.counts) + int(x) % o.tail for k, x in zip(number, t)]
        for i, (x, k) in enumerate(zip(t, number)):
            total += plain_log10(m, ctx[i + 1], ctx[i], k)
            if k < 0:
                total += math.log10((count[int(np.uint64(x).view(np.int64))] + 1) / v.rare_total)
        assert abs(got[r.doc_id].score - total) < 1e-3 * len(t)


def test_nce_learns_a_pattern():
    v = small_vocabulary([1000] * 6, 3, rare=1000, more=1)
    t = neural_lm.Trainer(v, neural_lm.LmOptions(dims=8, tail=2), 1)
    w = np.tile(np.arange(-1, 6, dtype=np.int32), 150)
    ctx = np.where(w < 0, 6, w)
    for _ in range(150):
        t.learn(np.roll(ctx, 1), np.roll(ctx, 2), w)
    m = neural_lm.scorer(v, t.p)
    lp = m.log_probability(np.roll(ctx, 1)[:7], np.roll(ctx, 2)[:7], w[:7])
    assert (np.exp(lp) > 0.8).all()


def test_passes_of_the_quality_network_do_not_depend_on_rows(monkeypatch):
    make, passes = np.random.default_rng, []

    class Counted:
        def __init__(self, seed):
            self.rng = make(seed)

        def shuffle(self, x):
            passes[-1] += 1
            self.rng.shuffle(x)

        def __getattr__(self, name):
            return getattr(self.rng, name)

    monkeypatch.setattr(quality_model.np.random, "default_rng", Counted)
    o = quality_model.VectorOptions(dims=1, hidden=2, epochs=3)
    for n in (200, 6000):
        x = make(n).standard_normal((n, 5)).astype(np.float32)
        passes.append(0)
        quality_model.train(np.zeros((1, 1), np.float32), x, (x[:, 0] > 0).astype(np.float32), o)
    assert passes == [3, 3]


def test_lm_step_is_the_same_in_pieces_of_any_size(monkeypatch):
    rng = np.random.default_rng(3)
    v = small_vocabulary(np.sort(rng.integers(1, 50, 40))[::-1].copy(), 6)
    one, two, w = (rng.integers(-1 if k == 2 else 0, 40, 500) for k in range(3))
    got = []
    for size in (2, 512):
        monkeypatch.setattr(neural_lm, "_PIECE", size)
        t = neural_lm.Trainer(v, neural_lm.LmOptions(dims=4, tail=3), 1)
        t.learn(one, two, w)
        got.append(t.p)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(*got))


def test_lm_row_sums_and_hash_look_up_equal_plain_ones():
    rng = np.random.default_rng(4)
    rows, grad = rng.zipf(1.5, 900) % 60, rng.standard_normal((900, 3))
    groups = neural_lm.Rows(rows, 60)
    want = np.zeros((60, 3))
    np.add.at(want, rows, grad)
    assert sorted(groups.at) == sorted(set(rows)) and np.allclose(groups.sums(grad), want[groups.at])
    assert np.allclose(groups.sums(grad[:, 0]), want[groups.at, 0])
    h = np.unique(rng.integers(0, 1 << 64, 3000, np.uint64, endpoint=False))
    v = neural_lm.Vocabulary(0, 0, h, h, h, h, h, 1)
    t = np.concatenate([h[::7], h[::5] + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
    at, hot = neural_lm.look_up(v, t)
    assert (at == np.minimum(np.searchsorted(h, t), len(h) - 1)).all() and (hot == np.isin(t, h)).all()
