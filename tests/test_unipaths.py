"""Unipaths against a plain compaction; lookups with both limits; the stored index and its plan."""

import random
from collections import Counter, defaultdict

import pytest

from ravel.functions.dna import kmer_code
from ravel.operators import seeding as S
from ravel.operators import unipaths as U
from ravel.schema import AlignOptions
from ravel.sources import index_store as I


def contigs(seed, repeats=True):
    r = random.Random(seed)
    g = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    rep = g(90)
    return {"a": g(700) + rep + g(300) + rep + g(50), "b": rep[10:60] + g(1500) + "N" * 9 + g(200) + rep, "c": "AC" * 40 + g(30) + "A" * 50, "d": g(11), "e": g(5), "f": "", "g": rep}


def plain_unipaths(refs, k):
    """Lists of k-mers of each unipath, by following links one after another."""
    after, before = defaultdict(set), defaultdict(set)
    for c, s in refs.items():
        kmers = [s[i : i + k] for i in range(len(s) - k + 1)]
        kmers = [None] + [x if set(x) <= set("ACGT") else None for x in kmers] + [None]
        for x, y in zip(kmers, kmers[1:]):
            if x:
                after[x].add(y)
            if y:
                before[y].add(x)
    joined = {x: y for x, ys in after.items() for y in ys if y and len(ys) == 1 and len(before[y]) == 1}
    heads = set(after) - set(joined.values())
    out = set()
    for x in heads:
        path = [x]
        while path[-1] in joined:
            path.append(joined[path[-1]])
        out.add(tuple(path))
    assert sum(map(len, out)) == len(after)
    return out


@pytest.mark.parametrize("k", [5, 11, 22])
def test_unipaths_equal_plain_compaction(spark, k):
    refs = contigs(k)
    copies = Counter(s[i : i + k] for s in refs.values() for i in range(len(s) - k + 1))
    pieces = [(c, i, s[i : i + 97]) for c, s in refs.items() for i in range(0, len(s), 97)]
    df = spark.createDataFrame(pieces, "chr string, at long, seq string").repartition(3)
    got = defaultdict(dict)
    for r in U.unipath_kmers(df, k).collect():
        got[r.chr, r.unipath][r.offset] = r.kmer
        assert r.copies == copies[r.kmer] and refs[r.chr][r.pos - 1 :].startswith(r.kmer)
    paths = {tuple(p[i] for i in range(len(p))) for p in got.values()}
    assert paths == plain_unipaths(refs, k)
    rows = U.unipaths(U.unipath_kmers(df, k)).collect()
    assert sorted((r.kmers, r.copies) for r in rows) == sorted((len(p), copies[p[0]]) for p in paths)


@pytest.mark.parametrize("most,copies", [(30, 5), (3, 5), (1, 1), (30, 1)])
def test_lookups_keep_both_limits(spark, most, copies):
    refs = contigs(3)
    k, seed = 12, 5
    where = defaultdict(list)
    for c, s in refs.items():
        for i in range(len(s) - k + 1):
            if "N" not in s[i : i + k]:
                where[s[i : i + k]].append((c, i + 1))
    begins = Counter(x[:seed] for x in where)
    want = sorted((x[:seed], c, p) for x, at in where.items() if len(at) <= copies and begins[x[:seed]] <= most for c, p in at)
    df = spark.createDataFrame(list(refs.items()), "chr string, seq string")
    got = sorted((r.kmer, r.chr, r.pos) for r in U.lookup_table(df, k, seed, most, copies).collect())
    assert got == want and want
    assert most > 3 or max(begins.values()) > most


def test_a_stored_index_is_read_where_it_lies(spark, tmp_path):
    refs = contigs(9)
    df = spark.createDataFrame(list(refs.items()), "chr string, seq string")
    o = AlignOptions(k=15)
    name = "stored_index_of_the_test"
    I.drop_index(spark, name)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS ravel_test LOCATION '{tmp_path}'")
    name = f"ravel_test.{name}"
    try:
        I.build_index(df, name, o, index_k=22, buckets=4)
        other = spark.createDataFrame([(c, i, s[i : i + 50].lower()) for c, s in refs.items() for i in range(0, len(s), 50)], "chr string, at long, seq string").repartition(5)
        index = I.open_index(spark, name, other, o)
        want = U.lookup_table(df, 22, 15, o.max_unipath, o.max_copies).withColumn("kmer", kmer_code("kmer"))
        assert sorted(map(tuple, index.collect())) == sorted(map(tuple, want.select(*index.columns).collect()))
        with pytest.raises(ValueError, match="digest"):
            I.open_index(spark, name, df.filter("chr <> 'g'"), o)
        with pytest.raises(ValueError, match="max_copies"):
            I.open_index(spark, name, df, AlignOptions(k=15, max_copies=4))
        with pytest.raises(ValueError, match="finished"):
            I.open_index(spark, f"{name}_2", df, o)
        with pytest.raises(ValueError, match="already"):
            I.build_index(df, name, o)
        reads = spark.createDataFrame([("r", "+", refs["a"][5:600])], "read_id string, strand string, seq string")
        threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            hits = S.grid_seeds(reads, o).join(index, "kmer")
            assert hits.count() > 10
            plan = hits._jdf.queryExecution().executedPlan().toString()
            # one exchange, that of the seeds
            assert plan.split("Final Plan")[-1].split("Initial Plan")[0].count("Exchange hashpartitioning(kmer") == 1 and "Bucketed: true" in plan
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    finally:
        spark.sql("DROP DATABASE IF EXISTS ravel_test CASCADE")
