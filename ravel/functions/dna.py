"""Sequence functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_bases(seq: Column) -> Column:
    """Upper case, U read as T."""
    return F.translate(F.upper(seq), "U", "T")


def reverse_complement(seq: Column) -> Column:
    """Case is kept; letters other than ACGT stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def base_codes(seq: Column) -> Column:
    """ACGT as 0123, all else as 4."""
    return F.regexp_replace(F.translate(F.upper(seq), "ACGT", "0123"), "[^0-3]", "4")


def kmer_code(kmer: Column) -> Column:
    """Two bits a base as a long (at most 31 bases); null if there is another letter."""
    digits = F.translate(F.upper(kmer), "ACGT", "0123")
    return F.when(F.upper(kmer).rlike("^[ACGT]{1,31}$"), F.conv(digits, 4, 10).cast("bigint"))


def clean_runs(seq: Column, k: int) -> Column:
    """The maximal runs without N of at least k letters."""
    return F.regexp_extract_all(seq, F.lit(rf"([^Nn]{{{k},}})"), 1)


def kmers_of(seq: Column, k: int, first: int = 1, step: int = 1) -> Column:
    """Array of (pos, kmer), pos from 1."""
    last = F.length(seq) - k + 1
    at = F.when(last >= first, F.sequence(F.lit(first), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.cast("bigint").alias("pos"), F.substring(seq, i, F.lit(k)).alias("kmer")))
