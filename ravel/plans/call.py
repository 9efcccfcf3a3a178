"""The caller as one lazy plan: segments to calls with genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.operators import cluster, genotype
from ravel.operators.signatures import signatures
from ravel.plans.tables import materialise
from ravel.schema import CallOptions
from ravel.sources.sequences import bases_at, inserted_sequence

COMMON = {"sv_type": "string", "chr": "string", "pos": "bigint", "sv_len": "bigint", "chr2": "string", "pos2": "bigint", "orient": "string", "alt": "string", "support": "bigint", "cipos": "string", "cilen": "string", "search_pos": "bigint", "read_ids": "array<string>", "q_read": "string", "q_start": "bigint", "q_len": "bigint", "q_strand": "string"}


def aligned(calls: DataFrame) -> DataFrame:
    have = set(calls.columns)
    return calls.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in COMMON.items()))


def candidate_calls(sigs: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """Calls of all types, with call_id: a hash of what identifies a call."""
    parts = [cluster.indel_calls(sigs, "DEL", o), cluster.indel_calls(sigs, "INS", o), cluster.inversion_calls(sigs, o), cluster.duplication_calls(sigs, o), cluster.translocation_calls(sigs, o)]
    out = aligned(parts[0])
    for p in parts[1:]:
        out = out.union(aligned(p))
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sv_type", "chr", "pos", "sv_len", "chr2", "pos2", "orient")), F.array_join("read_ids", ","))
    return out.withColumn("call_id", F.md5(key.cast("binary")))


def call(segments: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """Genotyped calls of all types from skeleton segments. Signatures and calls are written once each, as five and three branches read them."""
    calls = materialise(candidate_calls(materialise(signatures(segments, o), "signatures"), o), "calls")
    return genotype.genotyped(calls, genotype.read_spans(segments, o.min_seg_len), o)


def with_sequences(calls: DataFrame, reads: DataFrame, reference: DataFrame) -> DataFrame:
    """calls with ref_seq and alt_seq for vcf.records: of a deletion what goes with the letter before it, and that letter; of an insertion the letter before it, with and without
    the stretch of its representative read (reads: read_id, seq); of others the letter at their place. reference: chr, seq, perhaps at."""
    kind, before = F.col("sv_type"), F.greatest(F.col("pos") - 1, F.lit(0))
    indel = kind.isin("DEL", "INS")
    rows = calls.withColumn("_at", F.when(indel, before).otherwise(F.col("pos")) + 1).withColumn("_n", F.when(kind == "DEL", F.col("pos") - F.col("sv_len") - before).otherwise(1))
    rows = inserted_sequence(bases_at(rows, reference, "_at", "_n", "ref_seq"), reads)
    first = F.substring("ref_seq", 1, 1)
    alt = F.when(kind == "DEL", first).when(kind == "INS", F.concat(first, "ins_seq"))
    return rows.withColumn("alt_seq", alt).drop("_at", "_n", "ins_seq")


def call_deletions(segments: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """Only deletions: the least plan from segments to genotypes."""
    from ravel.operators import signatures as S

    near = S.neighbours(S.usable_segments(segments, o))
    dels = S.merge_deletions(S.deletion_pairs(S.colinear_pairs(near), o), o).dropDuplicates()
    sigs = dels.withColumn("sv_type", F.lit("DEL")).withColumn("q_start", F.lit(None).cast("bigint"))
    calls = aligned(cluster.indel_calls(sigs, "DEL", o)).withColumn("call_id", F.concat_ws(":", "chr", F.col("pos").cast("string"), F.col("sv_len").cast("string"), F.md5(F.array_join("read_ids", ",").cast("binary"))))
    calls = materialise(calls, "calls")
    return genotype.genotyped(calls, genotype.read_spans(segments, o.min_seg_len), o)


def register_views(spark, segments: DataFrame, o: CallOptions = CallOptions()) -> None:
    """Temporary views segments, signatures, calls and spans, for SQL."""
    segments.createOrReplaceTempView("segments")
    signatures(segments, o).createOrReplaceTempView("signatures")
    genotype.read_spans(segments, o.min_seg_len).createOrReplaceTempView("spans")
    call(segments, o).createOrReplaceTempView("calls")
