"""Clusters, genotypes, VCF and evaluation on small inputs, and planted variants found again."""

import math

import pytest
from pyspark.sql import functions as F

from ravel import adapters as D
from ravel.operators import cluster as K
from ravel.operators import genotype as G
from ravel.operators.islands import gap_blocks
from ravel.operators.rangejoin import band, containing, overlapping
from ravel.plans.call import call
from ravel.schema import SEGMENTS, SPANS, CallOptions


def test_range_joins_equal_brute_force(spark):
    import random

    r = random.Random(1)
    a = [("c", x, x + r.randrange(500), i) for i in range(200) for x in [r.randrange(5000)]]
    b = [("c", x, x + r.randrange(300), i) for i in range(100) for x in [r.randrange(5000)]]
    s = spark.createDataFrame(a, "k string, s long, e long, i long")
    w = spark.createDataFrame(b, "k string, ws long, we long, j long")
    got = {(x.i, x.j) for x in containing(s, w, "k", 97, ("s", "e"), ("ws", "we")).collect()}
    assert got == {(i, j) for _, x, y, i in a for _, p, q, j in b if x < p and y > q}
    rows = overlapping(s, w, ["k"], 113, ("s", "e"), ("ws", "we")).collect()
    want = {(i, j) for _, x, y, i in a for _, p, q, j in b if max(x, p) <= min(y, q)}
    assert len(rows) == len(want) and {(x.i, x.j) for x in rows} == want
    rows = band(s, w, ["k"], "s", "ws", 50).collect()
    want = {(i, j) for _, x, _, i in a for _, p, _, j in b if abs(x - p) <= 50}
    assert len(rows) == len(want) and {(x.i, x.j) for x in rows} == want


def test_blocks_never_cut_inside_an_island(spark):
    import random

    r = random.Random(2)
    pos = sorted(r.randrange(20_000) for _ in range(300))
    df = gap_blocks(spark.createDataFrame([("c", p) for p in pos], "chr string, pos long"), ["chr"], "pos", 100)
    got = sorted((x.pos, x.block) for x in df.collect())
    assert all(b == a or q - p > 100 for (p, a), (q, b) in zip(got, got[1:])) and len({b for _, b in got}) > 1


@pytest.mark.parametrize("n", range(1, 11))
def test_trimmed_middle(spark, n):
    rows = [("c", 0, 0, 100 + i, 1100 + 2 * i, f"r{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "chr string, block long, cluster long, pos long, pos2 long, read_id string")
    got = K.trimmed_break_points(df, CallOptions(min_support=1)).select("pos", "pos2").first()
    lo, hi = int(n * 0.4), int(n * 0.6)
    mid = rows[lo:hi] or [rows[lo]]
    assert tuple(got) == (sum(x[3] for x in mid) // len(mid), sum(x[4] for x in mid) // len(mid))


def test_two_best_translocation_groups(spark):
    rows = [("TRA", "1", 1000, "A", "2", 5000, f"a{i}") for i in range(8)] + [("TRA", "1", 1010, "A", "2", 9000, f"b{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "sv_type string, chr string, pos long, orient string, chr2 string, pos2 long, read_id string")
    got = sorted((r.pos2, r.support, r.alt) for r in K.translocation_calls(df).collect())
    assert got == [(5000, 8, "N[2:5000["), (9000, 6, "N[2:9000[")]


def test_likelihood_against_plain_arithmetic(spark):
    grid = [(a, b) for a in range(0, 121, 7) for b in range(1, 121, 7)]
    df = spark.createDataFrame(grid, "a long, b long").withColumn("g", G.likelihoods(F.col("a"), F.col("b")))
    for r in df.collect():
        a, b = r.a, r.b
        if a + b > 100:
            a = int(100 * (a / (a + b)))
            b = 100 - a
        x = [a * math.log10(0.9) + b * math.log10(0.1), (a + b) * math.log10(0.5), a * math.log10(0.1) + b * math.log10(0.9)]
        top = max(x)
        lse = top + math.log10(sum(10 ** (v - top) for v in x))
        assert r.g.gt == ["0/0", "0/1", "1/1"][x.index(top)]
        assert [int(v) for v in r.g.pl.split(",")] == [round(-10 * min(v - lse, 0)) for v in x]


def test_span_takes_the_longest_interval_and_its_own_contig(spark):
    rows = [("r", 9000, 0, "1", "+", 0, 999, 1000, 2000, 1000), ("r", 9000, 1, "1", "+", 1000, 1999, 2100, 9000, 1000), ("r", 9000, 2, "2", "+", 2000, 2999, 100, 900, 1000)]
    got = G.read_spans(spark.createDataFrame(rows, SEGMENTS)).first()
    assert (got.chr, got.start, got.end) == ("1", 1000, 9000)


def test_reference_reads_are_those_that_span_without_support(spark):
    calls = spark.createDataFrame([("x", "DEL", "1", 5000, 300, None, 5000, ["a", "b"])], "call_id string, sv_type string, chr string, pos long, sv_len long, pos2 long, search_pos long, read_ids array<string>")
    spans = spark.createDataFrame([("1", 100, 9000, "a"), ("1", 100, 9000, "c"), ("1", 4000, 9000, "d"), ("1", 3999, 6001, "e"), ("2", 100, 9000, "f")], SPANS)
    assert G.genotyped(calls, spans).first().dr == 2


def test_planted_variants_are_found(spark, sf_dir):
    seg = D.planted_segments(D.table(spark, sf_dir, "orders"))
    got = call(seg).collect()
    truth = {(r.sv_type, r.chr): [] for r in got}
    for r in D.truth_view(D.table(spark, sf_dir, "orders")).collect():
        near = [g for g in got if g.sv_type == r.sv_type and g.chr == r.chr and abs(g.pos - r.start) <= 600]
        assert near, r
    dels = [g for g in got if g.sv_type == "DEL"]
    assert len(dels) == 8 and truth


def test_genotype_off_leaves_missing_marks(spark, sf_dir):
    seg = D.planted_segments(D.table(spark, sf_dir, "orders"))
    r = call(seg, CallOptions(genotype=False)).first()
    assert (r.gt, r.pl, r.dr, r.qual) == ("./.", ".,.,.", None, None)


def test_letters_are_derived_of_asked_reads_alone(spark, sf_dir):
    from ravel import catalog as C

    calls = spark.createDataFrame([("r1",), (None,)], "q_read string")
    plan = C._asked_reads(spark, sf_dir, calls)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("array_join") < plan.index("LeftSemi")


def test_cluster_support_needs_no_distinct_count(spark):
    """Support is the size of the set of reads, so that no set is made for each read and merged."""
    rows = spark.createDataFrame([("DUP", "c", 100, 900, f"r{i % 11}") for i in range(20)], "sv_type string, chr string, pos long, pos2 long, read_id string")
    out = K.duplication_calls(rows)
    assert [(x.support, x.read_ids) for x in out.collect()] == [(11, sorted(f"r{i}" for i in range(11)))]
    assert "distinct count" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "count(distinct" not in plan


def test_support_is_grouped_with_spanning_reads(spark):
    """A read that spans one of two sites, both, both twice, or both and supports: only those of all sites without support count, and names are never one side's hash table."""
    calls = spark.createDataFrame([("a", ["r4"]), ("b", ["r1"])], "call_id string, read_ids array<string>")
    wins = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "call_id string, site int")
    found = spark.createDataFrame([("a", 1, "r1"), ("a", 1, "r2"), ("a", 2, "r2"), ("a", 2, "r3"), ("a", 2, "r3"), ("a", 1, "r3"), ("a", 1, "r4"), ("a", 2, "r4"), ("b", 1, "r1"), ("b", 1, "r2")], "call_id string, site int, read_id string")
    out = G.reference_reads(calls, found, wins)
    assert {(x.call_id, x.dr) for x in out.collect()} == {("a", 2), ("b", 1)}
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_records_leave_names_behind(spark):
    from ravel.sources import vcf

    row = ("DEL", "c", 5, -50, None, None, None, None, 3, "-1,1", "-1,1", ["r1"], 0, "1/1", "1,2,3", 4, 9.0)
    calls = spark.createDataFrame([row], "sv_type string, chr string, pos long, sv_len long, chr2 string, pos2 long, orient string, alt string, support long, cipos string, cilen string, read_ids array<string>, dr long, gt string, pl string, gq long, qual double")
    assert "read_ids" not in vcf.records(calls)._jdf.queryExecution().analyzed().toString()
    assert "RNAMES=r1" in vcf.records(calls, CallOptions(report_readid=True)).first().INFO


def test_samples_are_joined_as_blocks(spark):
    """A sample over the border of two blocks is whole, and the join has a row a block, not a row a rank."""
    spans = spark.createDataFrame([("c", i, 10_000, f"r{i}") for i in range(200)], SPANS)
    wins = spark.createDataFrame([("a", 1, "c", 500, 600, 60)], "call_id string, site int, chr string, win_start long, win_end long, cap long")
    out = G.sampled_reads(spans, wins)
    assert {x.read_id for x in out.collect()} == {f"r{i}" for i in range(99 - 30, 99 + 30)}
    assert "AS block" in out._jdf.queryExecution().analyzed().toString()


def test_abnormal_types_pair_no_spans_with_windows(spark, duck, sf_dir, monkeypatch):
    from support import same_rows

    from ravel import catalog, oracles

    def paired(*_):
        raise AssertionError("genotypes are not asked for")

    monkeypatch.setattr(G, "containing", paired)
    same_rows(catalog.abnormal_types(spark, sf_dir).toPandas(), duck.execute(oracles.ORACLES["abnormal_types"]).df())
