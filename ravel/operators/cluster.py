"""Clusters of signatures, by type: position islands, best signature of a read, alleles by length, break points.

Order within a contig is total: (pos, len, read_id, q_start) for deletions and insertions, (pos, pos2, read_id) for the others, numerically.
Large contigs are first cut at empty coarse bins (gap_blocks), which never lie inside a cluster, so one contig is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravel.operators.islands import gap_blocks, islands
from ravel.schema import CallOptions

READ = ["pos", "len", "read_id", "q_start"]


def names(column: str | Column = "read_id") -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def read_set() -> Column:
    """The aggregate read_ids: distinct reads in order. Their number is its size; a distinct count beside it would merge a set for each single read."""
    return F.sort_array(F.collect_set("read_id")).alias("read_ids")


def support() -> Column:
    return F.size("read_ids").cast("bigint")


def position_clusters(sigs: DataFrame, bias: int, keys: tuple[str, ...] = ("chr",), order: list[str] | None = None, blocks: bool = True) -> DataFrame:
    """sigs (chr, pos, len, read_id, q_start) with `cluster`: a number that is unique within keys (and block)."""
    rows = gap_blocks(sigs, list(keys), "pos", bias) if blocks else sigs.withColumn("block", F.lit(0))
    return islands(rows, [*keys, "block"], order or READ, lambda prev: F.col("pos") - prev("pos") > bias, "cluster")


def best_per_read(rows: DataFrame, o: CallOptions, keys: tuple[str, ...] = ("chr", "block", "cluster")) -> DataFrame:
    """The longest signature of each read in a cluster (the first of equals), of clusters with enough rows and enough reads."""
    w = Window.partitionBy(*keys, "read_id").orderBy(F.desc("len"), "pos", "q_start")
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    kept = rows.withColumn("_n", size).filter(F.col("_n") >= o.min_support).withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    return kept.withColumn("_n", size).filter(F.col("_n") >= o.min_support).drop("_n", "_k")


def length_alleles(rows: DataFrame, ratio: float, keys: tuple[str, ...] = ("chr", "block", "cluster")) -> DataFrame:
    """rows with `allele`: by length, a new one where the step is over ratio times the mean length of the whole cluster."""
    mean = F.avg("len").over(Window.partitionBy(*keys))
    rows = rows.withColumn("_mean", mean)
    return islands(rows, list(keys), ["len", "pos", "read_id", "q_start"], lambda prev: F.col("len") - prev("len") > ratio * F.col("_mean"), "allele").drop("_mean")


def _ci(column: str) -> Column:
    c = F.floor(1.96 * F.stddev_pop(F.col(column) - F.lit(0)) / F.sqrt(F.count(F.lit(1)))).cast("bigint")
    return F.concat(F.lit("-"), c.cast("string"), F.lit(","), c.cast("string"))


def allele_summary(rows: DataFrame, sv_type: str, o: CallOptions, keys: tuple[str, ...] = ("chr", "block", "cluster", "allele")) -> DataFrame:
    """A call for each allele with enough support: chr, pos, sv_len, support, cipos, cilen, search_pos, read_ids, and for insertions with strands where their
    sequence stands: q_read, q_start, q_len, q_strand."""
    mean_pos, mean_len = F.avg("pos"), F.avg("len")
    aggs = [
        mean_pos.alias("_mp"), mean_len.alias("_ml"), F.min("pos").alias("_low"), F.count(F.lit(1)).alias("support"),
        _ci("pos").alias("cipos"), _ci("len").alias("cilen"), read_set(),
    ]
    inserted = sv_type == "INS" and "strand" in rows.columns
    if inserted:
        rows, best = _representative(rows, keys)
        aggs.append(best.alias("_q"))
    out = rows.groupBy(*keys).agg(*aggs).filter(F.col("support") >= o.allele_support)
    if inserted:
        out = out.select("*", "_q.*").drop("_q")
    pos, size = F.col("_mp").cast("bigint"), F.col("_ml").cast("bigint")
    out = out.withColumn("sv_type", F.lit(sv_type)).withColumn("pos", pos).withColumn("sv_len", -size if sv_type == "DEL" else size)
    return out.withColumn("search_pos", F.col("_low").cast("bigint") if sv_type == "DEL" else pos).drop("_mp", "_ml", "_low")


def _representative(rows: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """rows with a rank, and the aggregate that takes the best row's q_start, q_len, q_read, q_strand (see insertion_representative)."""
    w = Window.partitionBy(*keys)
    far = F.abs(F.col("pos") - F.avg("pos").over(w))
    near = (F.abs(F.col("len") - F.avg("len").over(w)) < 5) & (far < 2000)
    rank = F.struct(F.when(near, 0).otherwise(1).alias("a"), F.when(near, far).alias("b"), F.col("len").alias("c"), F.col("pos").alias("d"), F.col("read_id").alias("e"), F.col("q_start").alias("f"))
    best = F.min_by(F.struct("q_start", F.col("len").alias("q_len"), F.col("read_id").alias("q_read"), F.col("strand").alias("q_strand")), "_r")
    return rows.withColumn("_r", rank), best


def insertion_representative(rows: DataFrame, keys: tuple[str, ...] = ("chr", "block", "cluster", "allele")) -> DataFrame:
    """For each allele the read that its sequence is taken from: of those within 5 of the mean length the nearest to the mean position, if
    nearer than 2000 (the first of equals); else the first by length. keys, q_start, q_len, q_read, q_strand."""
    ranked, best = _representative(rows, keys)
    return ranked.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def indel_calls(sigs: DataFrame, sv_type: str, o: CallOptions = CallOptions()) -> DataFrame:
    """Deletion or insertion calls from the signatures of that type."""
    bias, ratio = (o.bias_del, o.ratio_del) if sv_type == "DEL" else (o.bias_ins, o.ratio_ins)
    rows = length_alleles(best_per_read(position_clusters(sigs.filter(F.col("sv_type") == sv_type), bias), o), ratio)
    return allele_summary(rows, sv_type, o)


def distinct_reads(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `_reads`, the number of distinct reads of the keys, from ranks instead of sets."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("_reads", F.dense_rank().over(w.orderBy("read_id"))).withColumn("_reads", F.max("_reads").over(w))


def inversion_clusters(sigs: DataFrame, o: CallOptions = CallOptions(), blocks: bool = True) -> DataFrame:
    """INV signatures with `cluster` (both break points within the bias of the row before, one orientation) and `inner` (by pos2)."""
    rows = gap_blocks(sigs, ["chr", "orient"], "pos", o.bias_inv) if blocks else sigs.withColumn("block", F.lit(0))
    rows = islands(rows, ["chr", "orient", "block"], ["pos", "pos2", "read_id"], lambda prev: (F.col("pos") - prev("pos") > o.bias_inv) | (F.col("pos2") - prev("pos2") > o.bias_inv), "cluster")
    keys = ["chr", "orient", "block", "cluster"]
    w = Window.partitionBy(*keys)
    rows = distinct_reads(rows.withColumn("_n", F.count(F.lit(1)).over(w)), keys).filter((F.col("_n") >= o.min_support) & (F.col("_reads") >= o.min_support)).drop("_n", "_reads")
    return islands(rows, keys, ["pos2", "pos", "read_id"], lambda prev: F.col("pos2") - prev("pos2") > o.bias_inv, "inner")


def inversion_calls(sigs: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """chr, pos, sv_len, pos2, support, orient, read_ids. Break points are means, halves to even."""
    rows = inversion_clusters(sigs.filter("sv_type = 'INV'"), o)
    out = rows.groupBy("chr", "orient", "block", "cluster", "inner").agg(F.count(F.lit(1)).alias("_n"), F.bround(F.sum("pos") / F.count(F.lit(1))).cast("bigint").alias("pos"), F.bround(F.sum("pos2") / F.count(F.lit(1))).cast("bigint").alias("pos2"), read_set())
    out = out.withColumn("support", support()).withColumn("sv_len", F.col("pos2") - F.col("pos")).filter((F.col("_n") >= o.min_support) & (F.col("support") >= o.min_support) & F.col("sv_len").between(o.min_size, o.max_size))
    return out.withColumn("sv_type", F.lit("INV")).withColumn("search_pos", F.col("pos")).drop("_n")


def duplication_calls(sigs: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """chr, pos, sv_len, pos2, support, read_ids. Break points are means of the middle fifth of the rows."""
    rows = gap_blocks(sigs.filter("sv_type = 'DUP'"), ["chr"], "pos", o.bias_dup)
    rows = islands(rows, ["chr", "block"], ["pos", "pos2", "read_id"], lambda prev: (F.col("pos") - prev("pos") > o.bias_dup) | (F.col("pos2") - prev("pos2") > o.bias_dup), "cluster")
    return trimmed_break_points(rows, o)


def trimmed_break_points(rows: DataFrame, o: CallOptions, keys: tuple[str, ...] = ("chr", "block", "cluster")) -> DataFrame:
    """A call for each cluster with enough rows and reads and a size within bounds."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_k", F.row_number().over(w.orderBy("pos", "pos2", "read_id")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    lo, hi = F.floor(F.col("_n") * 4 / 10), F.floor(F.col("_n") * 6 / 10)
    mid = ((F.col("_k") >= lo) & (F.col("_k") < hi)) | ((lo == hi) & (F.col("_k") == lo))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.avg(F.when(mid, F.col("pos"))).cast("bigint").alias("pos"), F.avg(F.when(mid, F.col("pos2"))).cast("bigint").alias("pos2"), read_set())
    out = out.withColumn("support", support()).withColumn("sv_len", F.col("pos2") - F.col("pos")).filter((F.col("_rows") >= o.min_support) & (F.col("support") >= o.min_support) & F.col("sv_len").between(o.min_size, o.max_size))
    return out.withColumn("sv_type", F.lit("DUP")).withColumn("search_pos", F.col("pos")).drop("_rows")


def translocation_clusters(sigs: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """TRA signatures with `cluster` (by pos) and `inner` (by pos2)."""
    keys = ["chr", "chr2", "orient"]
    rows = islands(gap_blocks(sigs, keys, "pos", o.bias_tra), [*keys, "block"], ["pos", "pos2", "read_id"], lambda prev: F.col("pos") - prev("pos") > o.bias_tra, "cluster")
    return islands(rows, [*keys, "block", "cluster"], ["pos2", "pos", "read_id"], lambda prev: F.col("pos2") - prev("pos2") > o.bias_tra, "inner")


def translocation_calls(sigs: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """chr, pos, chr2, pos2, orient, alt, support, read_ids: of each cluster its best group by distinct reads, or its best two."""
    keys = ["chr", "chr2", "orient", "block", "cluster"]
    rows = translocation_clusters(sigs.filter("sv_type = 'TRA'"), o)
    g = distinct_reads(rows, keys).groupBy(*keys, "inner").agg(F.max("_reads").alias("_reads"), F.count(F.lit(1)).alias("_n"), F.avg("pos").cast("bigint").alias("pos"), F.avg("pos2").cast("bigint").alias("pos2"), read_set()).withColumn("support", support())
    w = Window.partitionBy(*keys)
    by = w.orderBy(F.desc("support"), "inner")
    g = g.withColumn("_rank", F.row_number().over(by)).withColumn("_rows", F.sum("_n").over(w))
    g = g.withColumn("_d1", F.max(F.when(F.col("_rank") == 1, F.col("support"))).over(w)).withColumn("_d2", F.coalesce(F.max(F.when(F.col("_rank") == 2, F.col("support"))).over(w), F.lit(0)))
    both = F.col("_d2") >= 0.5 * o.min_support
    keep = F.when(both, (F.col("_rank") <= 2) & (F.col("_d1") + F.col("_d2") >= F.col("_rows") * o.ratio_tra)).otherwise((F.col("_rank") == 1) & (F.col("_d1") >= F.col("_rows") * o.ratio_tra))
    g = g.filter((F.col("_rows") >= o.min_support) & (F.col("_reads") >= o.min_support) & keep).drop("_n", "_rank", "_rows", "_reads", "_d1", "_d2")
    return g.withColumn("sv_type", F.lit("BND")).withColumn("search_pos", F.col("pos")).withColumn("alt", bnd_alt(F.col("orient"), F.col("chr2"), F.col("pos2")))


def bnd_alt(orient: Column, chr2: Column, pos2: Column) -> Column:
    """The ALT field of a breakend."""
    at = F.concat(chr2, F.lit(":"), pos2.cast("string"))
    return F.when(orient == "A", F.concat(F.lit("N["), at, F.lit("["))).when(orient == "B", F.concat(F.lit("N]"), at, F.lit("]"))).when(orient == "C", F.concat(F.lit("["), at, F.lit("[N"))).when(orient == "D", F.concat(F.lit("]"), at, F.lit("]N")))
