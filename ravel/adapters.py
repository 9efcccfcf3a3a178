"""Views of general tables in the shapes that the operators work on: planted variants from orders, points and spans from events, texts as reads.

All arithmetic is on integers, so any engine gets the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def planted_segments(orders: DataFrame) -> DataFrame:
    """Skeleton segments of one read an order, at 40 loci that carry a deletion, insertion, inversion, duplication or translocation in turn."""
    r = F.col("o_orderkey")
    locus = r % 40
    b = orders.select(
        F.concat(F.lit("r"), r.cast("string")).alias("read_id"), (locus % 5).alias("kind"), (100000 + 50000 * locus + F.col("o_custkey") % 11 - 5).alias("p"), (400 + (locus * 37) % 900).alias("n"),
        F.concat(F.lit("chr"), (locus % 3 + 1).cast("string")).alias("c"), F.concat(F.lit("chr"), ((locus + 1) % 3 + 1).cast("string")).alias("cb"),
        ((locus % 2 == 0) | (F.expr("o_orderkey div 40") % 3 != 0)).alias("carrier"), (F.expr("o_orderkey div 80") % 2 == 1).alias("minus"),
    )
    p, n, c, cb = (F.col(x) for x in ("p", "n", "c", "cb"))

    def seg(chrom: Column, strand: Column | str, a, z, x: Column, y: Column) -> Column:
        as_col = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("bigint")
        return F.struct(chrom.alias("chr"), (strand if isinstance(strand, Column) else F.lit(strand)).alias("strand"), as_col(a).alias("rd_l"), as_col(z).alias("rd_r"), as_col(x).alias("rf_l"), as_col(y).alias("rf_r"))

    m = F.col("minus")
    sign = F.when(m, "-").otherwise("+")
    kinds = {
        0: (F.lit(6000), [seg(c, sign, F.when(m, 3000).otherwise(0), F.when(m, 5999).otherwise(2999), p - 2999, p), seg(c, sign, F.when(m, 0).otherwise(3000), F.when(m, 2999).otherwise(5999), p + n, p + n + 2999)]),
        1: (6000 + n, [seg(c, "+", 0, 2999, p - 2999, p), seg(c, "+", 3000 + n, 5999 + n, p + 1, p + 3000)]),
        2: (6000 + n, [seg(c, "+", 0, 2999, p - 2999, p), seg(c, "-", 3000, 2999 + n, p, p + n), seg(c, "+", 3000 + n, 5999 + n, p + n, p + n + 3000)]),
        3: (F.lit(6500), [seg(c, "+", 0, 2999, p + n - 2999, p + n), seg(cb, "+", 3000, 3499, p, p + 499), seg(c, "+", 3500, 6499, p, p + 2999)]),
        4: (F.lit(6000), [seg(c, "+", 0, 2999, p - 2999, p), seg(cb, "+", 3000, 5999, p + 7000, p + 9999)]),
    }
    length = F.when(~F.col("carrier"), 6000 + n)
    segs = F.when(~F.col("carrier"), F.array(seg(c, "+", 0, 5999 + n, p - 3000, p + 2999 + n)))
    for k, (size, parts) in kinds.items():
        length = length.when(F.col("kind") == k, size)
        segs = segs.when(F.col("kind") == k, F.array(*parts))
    out = b.select("read_id", length.cast("bigint").alias("read_len"), F.posexplode(segs).alias("seg_idx", "s"))
    return out.select("read_id", "read_len", F.col("seg_idx").cast("bigint").alias("seg_idx"), "s.*", (F.col("s.rd_r") + 1 - F.col("s.rd_l")).alias("seg_len"))


def seconds() -> Column:
    """events.ts as seconds since 1970, without a time zone."""
    return F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")


def event_points(events: DataFrame) -> DataFrame:
    """chr (event type), pos (seconds since 2024), len, read_id (user), q_start (event)."""
    return events.select(F.col("event_type").alias("chr"), (seconds() - 1704067200).alias("pos"), F.floor("value").cast("bigint").alias("len"), F.col("user_id").cast("string").alias("read_id"), F.col("event_id").alias("q_start"))


def event_spans(events: DataFrame) -> DataFrame:
    """chr, start, end, read_id (event)."""
    s = seconds() - 1704067200
    return events.select(F.col("event_type").alias("chr"), s.alias("start"), (s + F.floor(F.col("value") * 20)).cast("bigint").alias("end"), F.col("event_id").cast("string").alias("read_id"))


def event_windows(events: DataFrame, every: int = 50) -> DataFrame:
    """A site for each event whose id is divisible by `every`: a stated set of queries against all spans."""
    s = seconds() - 1704067200
    return events.filter(F.col("event_id") % every == 0).select(F.col("event_id").cast("string").alias("call_id"), F.lit(1).alias("site"), F.col("event_type").alias("chr"), F.greatest(s - 500, F.lit(0)).alias("win_start"), (s + 500).alias("win_end"))


def line_chain(lineitem: DataFrame) -> DataFrame:
    """Segments of one read an order from its line items; repeats are told apart by their other columns."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    i = (F.row_number().over(w) - 1).cast("bigint")
    rows = lineitem.withColumn("i", i)
    part = F.col("l_partkey")
    rf = part * 97 + F.col("l_suppkey") * 13
    size = F.col("l_quantity").cast("bigint") * 20
    return rows.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("read_id"), F.lit(20000).cast("bigint").alias("read_len"), F.col("i").alias("seg_idx"), F.concat(F.lit("chr"), (part % 2).cast("string")).alias("chr"), F.when(F.col("l_suppkey") % 4 == 0, "-").otherwise("+").alias("strand"), (F.col("i") * 1000).alias("rd_l"), (F.col("i") * 1000 + size).alias("rd_r"), rf.alias("rf_l"), (rf + size).alias("rf_r"), (size + 1).alias("seg_len"))


def doc_reads(documents: DataFrame) -> DataFrame:
    return documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("read_id"), F.col("text").alias("seq"))


def bench_reference(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("chr"), F.col("text").alias("seq"))


#: The base of each byte: letters a to z by their place in the alphabet, modulo four, upper case alike; 0 for what is left out.
_BASE_OF = np.zeros(256, np.uint8)
for _i in range(26):
    _BASE_OF[[65 + _i, 97 + _i]] = ord("ACGT"[_i % 4])


def as_bases(df: DataFrame) -> DataFrame:
    """df with seq as bases: its letters a to z by their place in the alphabet, modulo four, all other signs left out.

    Bytes are looked up in a table, a batch at a time: as column expressions they were worked out anew in each filter on seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pc.fill_null(b.column("seq").cast(pa.large_string()), "")
            # the two other signs whose lower case has a letter of the alphabet: the Kelvin sign and I with a dot
            t = pc.replace_substring(pc.replace_substring(t, "\u212a", "k"), "\u0130", "i")
            ends = np.frombuffer(t.buffers()[1], np.int64, len(t) + 1, t.offset * 8) if len(t) else np.zeros(1, np.int64)
            data = np.frombuffer(t.buffers()[2], np.uint8) if len(t) and t.buffers()[2] else np.zeros(0, np.uint8)
            got = _BASE_OF[data[ends[0] : ends[-1]]]
            before = np.concatenate([[0], np.cumsum(got > 0)])[ends - ends[0]]
            seq = pa.LargeStringArray.from_buffers(len(t), pa.py_buffer(before.astype(np.int64)), pa.py_buffer(got[got > 0].tobytes()))
            yield pa.RecordBatch.from_arrays([seq.cast(pa.string()) if n == "seq" else b.column(n) for n in b.schema.names], names=b.schema.names)

    return df.mapInArrow(run, df.schema).filter("seq <> ''")


def _letters(number: Column) -> Column:
    """A letter for each number, by a fixed rule."""
    x = number * 1103515245 + 12345
    return F.substring(F.lit("ACGT"), (F.shiftright(x, 12) % 4 + 1).cast("int"), F.lit(1))


def planted_reference(spark: SparkSession, size: int = 2_200_000, piece: int = 10_000) -> DataFrame:
    """chr, at, seq: the letters of the three contigs that planted_segments lies on, in pieces."""
    rows = spark.range(0, size // piece, 1, 64).select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("c"), (F.col("id") * piece).alias("at"))
    seq = F.array_join(F.transform(F.sequence(F.col("at"), F.col("at") + piece - 1), lambda i: _letters(i * 3 + F.col("c"))), "")
    return rows.select(F.concat(F.lit("chr"), F.col("c").cast("string")).alias("chr"), "at", seq.alias("seq"))


def planted_reads(orders: DataFrame) -> DataFrame:
    """read_id, seq: letters for the reads of planted_segments."""
    r = F.col("o_orderkey")
    seq = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), 6000 + 400 + ((r % 40) * 37) % 900 - 1), lambda i: _letters(i * 7 + r)), "")
    return orders.select(F.concat(F.lit("r"), r.cast("string")).alias("read_id"), seq.alias("seq"))


def truth_view(orders: DataFrame) -> DataFrame:
    """truth_no, sv_type, chr, start, end, sv_len, chr2, pos2: the 40 planted events, of the loci that orders has."""
    locus = orders.select((F.col("o_orderkey") % 40).cast("bigint").alias("l")).distinct()
    l, n, p = F.col("l"), 400 + (F.col("l") * 37) % 900, 100000 + 50000 * F.col("l")
    kind = F.element_at(F.array(*(F.lit(t) for t in ("DEL", "INS", "INV", "DUP", "BND"))), (l % 5 + 1).cast("int"))
    a, b = F.concat(F.lit("chr"), (l % 3 + 1).cast("string")), F.concat(F.lit("chr"), ((l + 1) % 3 + 1).cast("string"))
    bnd = kind == "BND"
    x, y = p, p + 7000
    return locus.select(l.alias("truth_no"), kind.alias("sv_type"), F.when(bnd, F.least(a, b)).otherwise(a).alias("chr"), F.when(bnd & (b < a), y).otherwise(x).alias("start"), F.when(~bnd & (kind != "INS"), p + n).alias("end"), F.when(~bnd, n).alias("sv_len"), F.when(bnd, F.greatest(a, b)).alias("chr2"), F.when(bnd, F.when(b < a, x).otherwise(y)).alias("pos2"))


def genotype_view(spark: SparkSession) -> DataFrame:
    """chr, genotype of the three contigs."""
    return spark.createDataFrame([("chr1", "hom"), ("chr2", "het"), ("chr3", "hom")], "chr string, genotype string")


def contigs_view(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("chr1", 3_000_000), ("chr2", 3_000_000), ("chr3", 3_000_000)], "chr string, length bigint")
