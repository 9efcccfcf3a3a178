"""Encoder, packing and token files: exact ids, exact round trips, dense sequences."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ravel.llm import bpe, packing, token_files
from ravel.llm import textcore as X
from ravel.llm.common import read, text_and_id


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = ["", " ", "  a  b", "a b ", " a  b c　 d", "it's  don't 'll  x", "a\n b\n\n c", "é è ñ 'é' ", "à b Ã c", "<|endoftext|> x <|endoftext|>", "1 2 3.5 $ % x1 y", "日本 語 a b", "a\x1c b\x85 c", "a b", "a \n b", "x" * 5000 + " y", "Tab\t a b\t", "a 's b 't"]


@pytest.mark.parametrize("limit", [0, 50, 100_000])
def test_encoder_gives_the_librarys_ids(spark, sf_dir, library, limit):
    texts = ODD + [r.text for r in read(spark, sf_dir, "documents").limit(120).collect()]
    e = bpe.Encoder(bpe.default_path(), limit)
    for _ in range(2):
        got = []
        for s in X.slices(pa.array(texts), 20_000):
            flat, at = e.slice(s)
            got += [flat[a:b].tolist() for a, b in zip(at, at[1:])]
        assert got == [library(t) for t in texts]


def test_packing_is_whole_and_dense(spark, odd, library):
    rows = packing.pack(text_and_id(odd)).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted((str(i), n, k) for i, t in texts for n in [len(library(t)) + 1] for k in range(-(-n // 1024)))
    assert sorted((str(r.doc_id), sum(x.length for x in rows if x.doc_id == r.doc_id and x.doc_id == 8) or next(len(library(t)) + 1 for i, t in texts if i == r.doc_id), r.piece) for r in rows) == want
    ids = {i: np.array([*library(t), 2], "<u4") for i, t in texts}
    by = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 1024


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_up_every_length_and_packs_tightly(seed):
    rng = np.random.default_rng(seed)
    o = packing.PackOptions()
    hist = np.bincount(np.clip((rng.lognormal(5, 1, 20_000) if seed < 3 else rng.integers(600, 1025, 5000)).astype(int), 1, 1024), minlength=1025)
    made = packing.plan(hist, o)
    used = np.zeros(1025, int)
    for p, k in made:
        assert sum(p) <= 1024 and k > 0
        for a in p:
            used[a] += k
    assert (used == hist).all()
    n, total = sum(k for _, k in made), int((hist * np.arange(1025)).sum())
    if seed < 3:
        assert n <= -(-total // 1024) * 1.005 + 1
    else:
        assert n == int(hist.sum())


def test_plan_of_nothing():
    assert packing.plan(np.zeros(1025, int), packing.PackOptions()) == []


def test_least_squares_is_optimal_on_a_small_case():
    hist = np.zeros(1025)
    hist[[1000, 24, 512, 500]] = [10, 14, 8, 3]
    p = [(1000, 24), (512, 512), (500, 500, 24)]
    x = packing.least_squares(p, hist, 2000)
    a = np.zeros((1025, 3))
    for k, q in enumerate(p):
        for v in q:
            a[v, k] += 1
    grad = a.T @ (a @ x - hist)
    assert (x >= 0).all() and (grad > -1e-3).all() and np.abs(grad * x).max() < 1e-2


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    o = token_files.FileOptions()
    docs = [np.append(rng.choice([5, 6, 7, 5], n), 2) for n in (0, 1, 2, 3000, 0, 50)] + [np.array([9] * 999 + [2])]
    n = np.array([len(x) for x in docs])
    raw = token_files.write_shard([None, 1, 2, 3, 4, 5, 6], np.concatenate(docs).astype(np.uint32), n, 50257, o)
    s = token_files.Shard(raw)
    assert s.decode(0, 7).tolist() == np.concatenate(docs).tolist() and len(s.rules) > 5 and len(s.sym) < n.sum() / 3
    for i, d in enumerate(docs):
        assert s.decode(i, i + 1).tolist() == d.tolist()
    assert s.doc_ids.to_pylist() == [None, 1, 2, 3, 4, 5, 6]
    assert (np.array([len(token_files.expansions(s.rules, 50257)[0])]) > 50257).all() and (s.lengths >= 2).all()
    with pytest.raises(ValueError):
        token_files.Shard(raw[:-1] + bytes([raw[-1] ^ 1]))


def test_files_hold_the_librarys_ids_in_order(spark, odd, library):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = token_files.write(odd, options=token_files.FileOptions(shard_ids=2000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.count() > 1
    rows = sorted(token_files.read_back(shards).collect(), key=lambda r: r.start)
    texts = odd.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    texts.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    at = 0
    for r, t in zip(rows, texts):
        ids = [*library(t.text), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (t.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.fetch(shards, 7) == [[*library("Two words"), 2]]
    assert token_files.fetch(shards, 4) == [[2]] and token_files.fetch(shards, 99) == [] and len(token_files.fetch(shards, None)) == 1
    assert len(token_files.fetch(shards, 2)) == 2


def test_fetch_reads_the_one_shard_that_has_the_document(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 600) for i in range(200)], "doc_id long, text string").repartition(4)
    shards = token_files.write(docs, options=token_files.FileOptions(shard_ids=1000))
    assert shards.count() >= 8
    for i in (0, 77, 199):
        assert token_files.shards_with(shards, i).count() == 1 and len(token_files.fetch(shards, i)) == 1
    assert token_files.shards_with(shards, 1000).count() == 0 and token_files.shards_with(shards, None).count() == 0


def plain_repair(docs, first, most):
    """The symbols left when the most frequent pair is replaced, one pair at a time, until none is found twice or `most` rules are there."""
    docs, made = [list(d) for d in docs], 0
    while made < most:
        c = {}
        for d in docs:
            i = 0
            while i < len(d) - 1:
                p = (d[i], d[i + 1])
                c[p] = c.get(p, 0) + 1
                i += 2 if i + 2 < len(d) and d[i] == d[i + 1] == d[i + 2] else 1  # a row of one symbol holds half as many pairs
        best = max(c, key=c.get, default=None)
        if best is None or c[best] < 2:
            break
        for k, d in enumerate(docs):
            out, i = [], 0
            while i < len(d):
                if i + 1 < len(d) and (d[i], d[i + 1]) == best:
                    out.append(first + made)
                    i += 2
                else:
                    out.append(d[i])
                    i += 1
            docs[k] = out
        made += 1
    return sum(map(len, docs)), made


@pytest.mark.parametrize("first,length", [(50257, 2500), (65535 - 300, 12_000)])
def test_repair_is_as_short_as_replacing_one_pair_at_a_time(spark, sf_dir, library, first, length):
    texts = [r.text for r in read(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").limit(60).collect()]
    docs, size = [], 0
    for t in texts:
        d = [x % 1009 for x in library(t)] + [2]
        docs.append(d[: length - size])
        size += len(docs[-1])
        if size >= length:
            break
    last = np.zeros(size, bool)
    last[np.cumsum([len(d) for d in docs]) - 1] = True
    o = token_files.FileOptions(rules_per_round=16)
    sym, rules, _ = token_files.repair(np.concatenate([np.array(d) for d in docs]), last, first, o)
    want, made = plain_repair(docs, first, 65535 - first)
    assert len(sym) <= 1.02 * want and len(rules) <= 65535 - first
    if made < 65535 - first:  # it ended because no pair was left: so it is here
        assert plain_repair([x.tolist() for x in np.split(sym, np.flatnonzero(_)[:-1] + 1)], first + len(rules), 10**6)[1] == 0


def test_encoder_gives_the_librarys_ids_for_any_mixture(library):
    import random

    plain = Tokenizer.from_file(bpe.default_path())
    marks = list("aab 's'tdl  12.,-!\n\n\tZÉé×÷ñß²½ª°日 　\x85\x1cÃ\u0301") + ["<|endoftext|>", " don't", "'re", "'ll've", "<|", "|>", "x" * 40, "\r\n"]
    r = random.Random(5)
    texts = ["".join(r.choice(marks) for _ in range(r.randrange(60))) for _ in range(1500)]
    for want, specials in ((library, True), (lambda t: plain.encode(t, add_special_tokens=False).ids, False)):
        e, got = bpe.Encoder(bpe.default_path(), plain_specials=specials), []
        for s in X.slices(pa.array(texts), 2000):
            flat, at = e.slice(s)
            got += [flat[a:b].tolist() for a, b in zip(at, at[1:])]
        assert got == [want(t) for t in texts] and e.held > 100


def test_special_tokens_in_texts_are_what_the_library_makes_of_them(spark):
    library = Tokenizer.from_file(bpe.default_path())
    texts = [*ODD, "a b <|endoftext|> c d", "a<|endoftext|>b c", "<|endoftext|>", "a <|endoftext|><|endoftext|> b <|endo ftext|> c  <|endoftext|>  d " * 40]
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert want[len(ODD) + 2] == [50256]
    for limit in (0, 100_000):
        e, got = bpe.Encoder(bpe.default_path(), limit, plain_specials=False), []
        for s in X.slices(pa.array(texts), 20_000):
            flat, at = e.slice(s)
            got += [flat[a:b].tolist() for a, b in zip(at, at[1:])]
        assert got == list(want.values())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    want = {i: [*x, 2] for i, x in want.items()}
    crc = {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in want.items()}
    rows = token_files.read_back(token_files.write(docs)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in rows} == {i: (len(x), crc[i]) for i, x in want.items()}
    for r in packing.pack(docs).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
