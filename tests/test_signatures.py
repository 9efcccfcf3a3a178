"""Signature rules on segments written out by hand."""

import pytest
from pyspark.sql import functions as F

from ravel.operators import signatures as S
from ravel.schema import SEGMENTS, CallOptions


def segments(spark, *reads):
    """reads: (read_len, [(chr, strand, rd_l, rd_r, rf_l, rf_r), ...])."""
    rows = [(f"r{i}", n, j, c, s, a, b, x, y, b + 1 - a) for i, (n, segs) in enumerate(reads) for j, (c, s, a, b, x, y) in enumerate(segs)]
    return spark.createDataFrame(rows, SEGMENTS)


def found(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def sigs(spark, read, sv_type, *cols, **kw):
    return found(S.signatures(segments(spark, read), CallOptions(**kw)).filter(F.col("sv_type") == sv_type), *cols)


def test_deletion_forward_and_reverse(spark):
    plus = (6000, [("1", "+", 0, 2999, 1000, 4000), ("1", "+", 3000, 5999, 4500, 7500)])
    minus = (6000, [("1", "-", 3000, 5999, 1000, 4000), ("1", "-", 0, 2999, 4500, 7500)])
    assert sigs(spark, plus, "DEL", "pos", "len") == [(4000, 499)]
    assert sigs(spark, minus, "DEL", "pos", "len") == [(4000, 499)]


@pytest.mark.parametrize("gap,want", [(200, 1), (201, 0)])
def test_deletion_read_gap_limit(spark, gap, want):
    read = (9000, [("1", "+", 0, 2999, 1000, 4000), ("1", "+", 2999 + gap, 5999 + gap, 5000, 8000)])
    assert len(sigs(spark, read, "DEL", "pos")) == want


@pytest.mark.parametrize("size,want", [(29, 0), (30, 1), (100_000, 1), (100_001, 0)])
def test_insertion_size_limits(spark, size, want):
    read = (300_000, [("1", "+", 0, 2999, 1000, 4000), ("1", "+", 3000 + size, 6000 + size, 4001, 7001)])
    assert len(sigs(spark, read, "INS", "len")) == want


def test_overlapping_reference_gives_half_positions_truncated(spark):
    # the second segment begins 101 before the first ends on the reference, and 50 before it on the read
    read = (6000, [("1", "+", 0, 2999, 1000, 4000), ("1", "+", 2949, 5999, 3899, 6949)])
    assert sigs(spark, read, "INS", "pos", "len") == [(3949, 51)]
    read = (6000, [("1", "+", 0, 2999, 1000, 4000), ("1", "+", 2849, 5999, 3899, 6949)])
    assert sigs(spark, read, "DEL", "pos", "len") == [(3949, 49)]


def test_inversion_pair_and_triples(spark):
    two = (6000, [("1", "+", 0, 2999, 1000, 4000), ("1", "-", 3000, 5999, 4500, 7500)])
    assert sigs(spark, two, "INV", "orient", "pos", "pos2") == [("++", 4000, 7500)]
    rev = (6000, [("1", "-", 0, 2999, 1000, 4000), ("1", "+", 3000, 5999, 4500, 7500)])
    assert sigs(spark, rev, "INV", "orient", "pos", "pos2") == [("--", 1000, 4500)]
    pmp = (9000, [("1", "+", 0, 2999, 1000, 4000), ("1", "-", 3000, 3999, 4000, 5000), ("1", "+", 4000, 6999, 5000, 8000)])
    assert sigs(spark, pmp, "INV", "orient", "pos", "pos2") == [("++", 4000, 5000), ("--", 4000, 5000)]
    mpm = (9000, [("1", "-", 0, 2999, 5000, 8000), ("1", "+", 3000, 3999, 4000, 5000), ("1", "-", 4000, 6999, 1000, 4000)])
    assert sigs(spark, mpm, "INV", "orient", "pos", "pos2") == [("++", 4000, 5000), ("--", 4000, 5000)]
    ppm = (9000, [("1", "+", 0, 999, 1000, 2000), ("1", "+", 1000, 2999, 2001, 4000), ("1", "-", 3000, 5999, 4500, 7500)])
    assert sigs(spark, ppm, "INV", "orient", "pos", "pos2") == [("++", 4000, 7500)]
    pmm = (9000, [("1", "+", 0, 2999, 1000, 4000), ("1", "-", 3000, 4999, 5500, 7500), ("1", "-", 5000, 5999, 4500, 5499)])
    assert sigs(spark, pmm, "INV", "orient", "pos", "pos2") == [("++", 4000, 7500)]


@pytest.mark.parametrize("strands,first,swapped", [("++", "A", "D"), ("+-", "B", "B"), ("-+", "C", "C"), ("--", "D", "A")])
def test_translocation_types_in_both_contig_orders(spark, strands, first, swapped):
    for (a, b), want in ((("1", "2"), first), (("2", "1"), swapped)):
        read = (6000, [(a, strands[0], 0, 2999, 1000, 4000), (b, strands[1], 3000, 5999, 7000, 9999)])
        x = 4000 if strands[0] == "+" else 1000
        y = 7000 if strands[1] == "+" else 9999
        pos = (x, y) if a == "1" else (y, x)
        assert sigs(spark, read, "TRA", "orient", "chr", "chr2", "pos", "pos2") == [(want, "1", "2", *pos)]


def test_return_from_another_contig_makes_a_duplication(spark):
    read = (6500, [("1", "+", 0, 2999, 2001, 5000), ("2", "+", 3000, 3499, 100, 600), ("1", "+", 3500, 6499, 4000, 6999)])
    assert sigs(spark, read, "DUP", "pos", "pos2") == [(4000, 5000)]
    assert sigs(spark, read, "INS", "pos", "len") == [(4000, 1501)]


def test_short_segments_go_after_the_count_of_segments(spark):
    short = (6000, [("1", "+", 0, 2999, 1000, 4000), ("1", "+", 3000, 3298, 4500, 4798), ("1", "+", 3299, 5999, 5300, 8000)])
    assert S.usable_segments(segments(spark, short)).count() == 2
    single = (3000, [("1", "+", 0, 2999, 1000, 4000)])
    assert S.usable_segments(segments(spark, single)).count() == 0


def test_merges_within_a_read(spark):
    ins = [("r", "1", "+", 0, 0, 100.0, 40, 7), ("r", "1", "+", 0, 1, 200.0, 50, 8), ("r", "1", "-", 0, 2, 250.0, 60, 9), ("r", "1", "-", 0, 3, 351.0, 70, 10)]
    df = spark.createDataFrame(ins, "read_id string, chr string, strand string, src int, ord long, pos double, len long, q_start long")
    assert found(S.merge_insertions(df), "strand", "pos", "len", "q_start") == [("+", 150, 90, 7), ("-", 250, 60, 9), ("-", 351, 70, 10)]
    dels = [("r", "1", 0, 100.0, 50), ("r", "1", 1, 150.0, 50), ("r", "1", 2, 201.0, 50)]
    df = spark.createDataFrame(dels, "read_id string, chr string, ord long, pos double, len long")
    assert found(S.merge_deletions(df), "pos", "len") == [(100, 100), (201, 50)]


def test_no_segments(spark):
    assert S.signatures(spark.createDataFrame([], SEGMENTS)).count() == 0


def test_rules_read_written_neighbours(spark):
    """No rule sorts the segments again: the plan of all signatures has no window that looks ahead."""
    plan = S.signatures(spark.createDataFrame([], SEGMENTS))._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(" not in plan
