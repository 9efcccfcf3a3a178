"""Schemas and options. Defaults are those of the command-line tool this package stands in for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

READS = struct(read_id=_S, seq=_S, read_len=_L)
CONTIGS = struct(chr=_S, length=_L)
REFERENCE = struct(chr=_S, seq=_S)
#: A skeleton segment: read coordinates on the forward read, both ends inclusive.
SEGMENTS = struct(read_id=_S, read_len=_L, seg_idx=_L, chr=_S, strand=_S, rd_l=_L, rd_r=_L, rf_l=_L, rf_r=_L, seg_len=_L)
SPANS = struct(chr=_S, start=_L, end=_L, read_id=_S)
ANCHORS = struct(read_id=_S, strand=_S, chr=_S, rd_l=_L, rd_r=_L, rf_l=_L, rf_r=_L)
TRUTH_BED = struct(chr=_S, start=_L, end=_L, kind=_S, payload=_S, extra=_S)


@dataclass(frozen=True)
class CallOptions:
    """Options of the caller."""

    min_seg_len: int = 300
    min_size: int = 30
    max_size: int = 100_000
    merge_del: int = 0
    merge_ins: int = 100
    min_support: int = 10
    genotype: bool = True
    report_readid: bool = False
    sample: str = "NULL"
    bias_ins: int = 800
    bias_del: int = 1000
    bias_inv: int = 500
    bias_dup: int = 500
    bias_tra: int = 50
    ratio_ins: float = 0.9
    ratio_del: float = 0.5
    ratio_tra: float = 0.6
    #: False: all spanning reads count; True: those of a sample of ref_cap() spans around the site, by position.
    capped: bool = False
    id_prefix: str = "ravel"

    @property
    def allele_support(self) -> int:
        return min(self.min_support, 5)


#: Preset for HiFi reads.
HIFI = CallOptions(merge_del=500, merge_ins=500)


@dataclass(frozen=True)
class AlignOptions:
    """Options of the skeleton aligner."""

    k: int = 22
    seed_step: int = 20
    max_unipath: int = 30
    max_copies: int = 5
    extend_mx: int = 5000
    edit_dis: int = 0
    rd_mx_gap: int = 1000
    rf_mx_gap: int = 1000
    top_n: int = 4
    min_chain_score: int = 100
    secondary_ratio: float = 0.8
    overlap_ratio: float = 0.4
    hash_k: int = 7
    block: int = 30
    sv_lim: int = 30
    error_model: int = 1
    min_read_len: int = 100
    max_predecessors: int = 51
    max_seeds: int = 25_000
    max_read_len: int = 1_000_000

    def errors(self) -> tuple[float, float, float]:
        """Insertion, deletion and mismatch rates. 1 is CCS, 2 is CLR."""
        return {1: (0.00087, 0.0034, 0.013), 2: (0.0592, 0.0301, 0.0527)}[self.error_model]

    def clamped(self) -> AlignOptions:
        from dataclasses import replace

        return replace(self, k=min(22, max(11, self.k)), hash_k=min(14, max(6, self.hash_k)), seed_step=max(5, self.seed_step))
