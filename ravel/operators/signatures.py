"""Signatures of structural variants from pairs and triples of neighbouring segments of a read.

The neighbours are windows over one partitioning (read_id), so the segments are shuffled once. They are written, and every rule reads what it needs of them; the merges inside a read shuffle
what their rules found.
Coordinates between the rules are doubles where halves occur and are truncated at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravel.operators.islands import islands
from ravel.plans.tables import materialise
from ravel.schema import CallOptions

SEG = ("seg_idx", "chr", "strand", "rd_l", "rd_r", "rf_l", "rf_r")
TYPES = {"chr": "string", "pos": "bigint", "len": "bigint", "q_start": "bigint", "strand": "string", "orient": "string", "chr2": "string", "pos2": "bigint"}
#: The wide layout of all types: DEL uses chr, pos, len; INS also q_start and strand; INV orient and pos2; TRA orient, chr2 and pos2; DUP pos2.
COLUMNS = ("sv_type", *TYPES, "read_id")


def usable_segments(segments: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """Segments of reads with two or more (counted before the length filter), of at least the least length."""
    n = F.count(F.lit(1)).over(Window.partitionBy("read_id"))
    return segments.withColumn("_n", n).filter("_n >= 2").drop("_n").filter(F.col("seg_len") >= o.min_seg_len)


def neighbours(segments: DataFrame) -> DataFrame:
    """read_id, read_len, n (segments of the read), i (from 0), s1, s2, s3: each segment with the next two, and `again`, the next one of the same contig and strand."""
    by_read = Window.partitionBy("read_id").orderBy("rd_l", "seg_idx")
    one = F.struct(*SEG)
    w = segments.withColumn("s1", one).withColumn("s2", F.lead("s1", 1).over(by_read)).withColumn("s3", F.lead("s1", 2).over(by_read)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("read_id"))).withColumn("i", F.row_number().over(by_read) - 1)
    w = w.withColumn("again", F.lead("s1", 1).over(Window.partitionBy("read_id", "chr", "strand").orderBy("rd_l", "seg_idx")))
    return w.select("read_id", "read_len", "n", "i", "s1", "s2", "s3", "again")


def oriented(a: Column, b: Column, read_len: Column) -> dict[str, Column]:
    """The pair (a, b) as on the forward strand: on reverse reads the two change places and read coordinates turn to L - x."""
    minus = a["strand"] == "-"

    def pick(plus: Column, turned: Column) -> Column:
        return F.when(minus, turned).otherwise(plus)

    return {
        "r1e": pick(a["rd_r"], read_len - b["rd_l"]),
        "r2s": pick(b["rd_l"], read_len - a["rd_r"]),
        "g1s": pick(a["rf_l"], b["rf_l"]),
        "g1e": pick(a["rf_r"], b["rf_r"]),
        "g2s": pick(b["rf_l"], a["rf_l"]),
        "g2e": pick(b["rf_r"], a["rf_r"]),
    }


def colinear_pairs(near: DataFrame) -> DataFrame:
    """Pairs of one contig and strand, oriented, with gr (gap on the read), gg (on the reference) and d = gr - gg."""
    same = near.filter((F.col("s1.chr") == F.col("s2.chr")) & (F.col("s1.strand") == F.col("s2.strand")))
    o = oriented(F.col("s1"), F.col("s2"), F.col("read_len"))
    pairs = same.select("read_id", "i", F.col("s1.chr").alias("chr"), F.col("s1.strand").alias("strand"), *(c.alias(k) for k, c in o.items()))
    return pairs.withColumn("gr", F.col("r2s") - F.col("r1e")).withColumn("gg", F.col("g2s") - F.col("g1e")).withColumn("d", F.col("gr") - F.col("gg"))


def _half(x: Column) -> Column:
    """x / 2 towards zero."""
    return (x / 2).cast("bigint")


def insertion_pairs(pairs: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """read_id, chr, strand, src, ord, pos (double), len, q_start."""
    r1e, r2s, g1e, g2s, gr, gg, d = (F.col(c) for c in ("r1e", "r2s", "g1e", "g2s", "gr", "gg", "d"))
    over = -gg
    overlap = (over >= o.min_size) & (d <= o.max_size)
    apart = (over < o.min_size) & (d >= o.min_size) & (gg <= 200) & (d <= o.max_size)
    half = (g2s + g1e) / 2
    pos = F.when(overlap & (r1e < r2s), g2s.cast("double")).when(overlap & (gr > gg), half).when(apart, F.when(g1e < g2s, g1e).otherwise(g2s).cast("double"))
    q = F.when(overlap & (r1e < r2s), r1e - over).when(overlap & (gr > gg), r1e + _half(gg)).when(apart, F.when(g1e < g2s, r1e).otherwise(r1e - over))
    return pairs.select("read_id", "chr", "strand", F.lit(0).alias("src"), F.col("i").alias("ord"), pos.alias("pos"), d.alias("len"), q.alias("q_start")).filter("pos IS NOT NULL")


def deletion_pairs(pairs: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """read_id, chr, ord, pos (double), len."""
    r1e, r2s, g1e, g2s, gr, gg, d = (F.col(c) for c in ("r1e", "r2s", "g1e", "g2s", "gr", "gg", "d"))
    over = -gg
    overlap = (over >= o.min_size) & (d <= o.max_size) & ~(r1e < r2s) & (gr <= gg)
    apart = (over < o.min_size) & (-d >= o.min_size) & (gr <= 200) & (-d <= o.max_size)
    pos = F.when(overlap, (g2s + g1e) / 2).when(apart, F.when(r1e < r2s, g1e).otherwise(g1e + r2s - r1e - 1).cast("double"))
    return pairs.select("read_id", "chr", F.col("i").alias("ord"), pos.alias("pos"), (-d).alias("len")).filter("pos IS NOT NULL")


def inversion_pair(a: Column, b: Column, o: CallOptions) -> Column:
    """An array with the signature of two segments on different strands, or an empty one."""
    plus = a["strand"] == "+"
    x, y = F.when(plus, a["rf_r"]).otherwise(a["rf_l"]), F.when(plus, b["rf_r"]).otherwise(b["rf_l"])
    size = F.abs(x - y)
    ok = (size >= o.min_size) & (b["rd_l"] + 0.5 * size >= a["rd_r"])
    one = F.struct(F.when(plus, "++").otherwise("--").alias("orient"), F.least(x, y).alias("pos"), F.greatest(x, y).alias("pos2"))
    return F.when(ok, F.array(one)).otherwise(F.array().cast("array<struct<orient:string,pos:bigint,pos2:bigint>>"))


def inversions(near: DataFrame, o: CallOptions = CallOptions(), pairs: bool = True, triples: bool = True) -> DataFrame:
    """read_id, chr, orient, pos, pos2 from reads of exactly two segments and from triples of longer ones."""
    a, b, c = F.col("s1"), F.col("s2"), F.col("s3")
    none = F.array().cast("array<struct<orient:string,pos:bigint,pos2:bigint>>")

    def two(x: tuple[Column, Column], y: tuple[Column, Column]) -> Column:
        return F.array(*(F.struct(F.lit(s).alias("orient"), p.alias("pos"), q.alias("pos2")) for s, (p, q) in (("++", x), ("--", y))))

    in_two = (F.col("n") == 2) & (F.col("i") == 0) & (a["chr"] == b["chr"]) & (a["strand"] != b["strand"])
    gap_f, gap_r = 0.5 * (c["rf_l"] - a["rf_r"]), 0.5 * (a["rf_l"] - c["rf_r"])
    ok_f = (b["rd_l"] + gap_f >= a["rd_r"]) & (c["rd_l"] + gap_f >= b["rd_r"])
    ok_r = (b["rd_l"] + gap_r >= a["rd_r"]) & (c["rd_l"] + gap_r >= b["rd_r"])
    mid = (a["strand"] == c["strand"]) & (a["strand"] != b["strand"])
    triple = (
        F.when(mid & (b["strand"] == "-"), F.when(ok_f, two((a["rf_r"], b["rf_r"]), (b["rf_l"], c["rf_l"]))).otherwise(none))
        .when(mid, F.when(ok_r, two((c["rf_r"], b["rf_r"]), (b["rf_l"], a["rf_l"]))).otherwise(none))
        .when((a["strand"] != c["strand"]) & (b["strand"] == a["strand"]), inversion_pair(b, c, o))
        .when(a["strand"] != c["strand"], inversion_pair(a, b, o))
        .otherwise(none)
    )
    in_three = (F.col("n") >= 3) & c.isNotNull() & (a["chr"] == b["chr"]) & (b["chr"] == c["chr"])
    found = F.when(in_two, inversion_pair(a, b, o)) if pairs else F.when(F.lit(False), none)
    if triples:
        found = found.when(in_three, triple)
    return near.withColumn("_f", F.explode(found)).select("read_id", a["chr"].alias("chr"), "_f.*")


def translocations(near: DataFrame) -> DataFrame:
    """read_id, chr (the lesser contig), orient (A to D), pos, chr2, pos2."""
    a, b = F.col("s1"), F.col("s2")
    less = a["chr"] < b["chr"]
    p, q = a["strand"] == "+", b["strand"] == "+"
    x = F.when(p, a["rf_r"]).otherwise(a["rf_l"])
    y = F.when(q, b["rf_l"]).otherwise(b["rf_r"])
    orient = F.when(p & q, F.when(less, "A").otherwise("D")).when(p, "B").when(q, "C").otherwise(F.when(less, "D").otherwise("A"))
    rows = near.filter((a["chr"] != b["chr"]) & (b["rd_l"] - a["rd_r"] <= 100))
    return rows.select("read_id", F.least(a["chr"], b["chr"]).alias("chr"), orient.alias("orient"), F.when(less, x).otherwise(y).alias("pos"), F.greatest(a["chr"], b["chr"]).alias("chr2"), F.when(less, y).otherwise(x).alias("pos2"))


def across_translocation(near: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """Pairs around a jump to another contig and back: kind INS (pos, len, q_start) or DUP (pos, pos2), with read_id, chr, strand, ord."""
    a, c = F.col("s1"), F.col("again")
    rows = near.filter((F.col("n") >= 3) & (a["chr"] != F.col("s2.chr")) & c.isNotNull())
    e = oriented(a, c, F.col("read_len"))
    rows = rows.select("read_id", a["chr"].alias("chr"), a["strand"].alias("strand"), F.col("i").alias("ord"), e["r1e"].alias("r1e"), e["g1e"].alias("g1e"), e["g2s"].alias("g2s"), (e["g2s"] - e["g1e"]).alias("dis_ref"), (e["r2s"] - e["r1e"]).alias("dis_read"))
    size = F.col("dis_read") - F.col("dis_ref")
    ins = F.when((F.col("dis_ref") < 100) & (size >= o.min_size) & (size <= o.max_size), F.struct(F.lit("INS").alias("kind"), F.least("g2s", "g1e").alias("pos"), size.alias("len"), (F.col("r1e") + _half(F.col("dis_ref"))).alias("q_start"), F.lit(None).cast("bigint").alias("pos2")))
    dup = F.when(F.col("dis_ref") <= -o.min_size, F.struct(F.lit("DUP").alias("kind"), F.col("g2s").alias("pos"), F.lit(None).cast("bigint").alias("len"), F.lit(None).cast("bigint").alias("q_start"), F.col("g1e").alias("pos2")))
    return rows.withColumn("_f", F.explode(F.array_compact(F.array(ins, dup)))).select("read_id", "chr", "strand", "ord", "_f.*")


def merge_insertions(rows: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """Insertions of a read and contig that follow each other within merge_ins on one strand become one. read_id, chr, strand, pos, len, q_start."""
    order = ["pos", "src", "ord"]
    t = islands(rows, ["read_id", "chr"], order, lambda prev: (F.col("pos") - prev("pos") > o.merge_ins) | (F.col("strand") != prev("strand")))
    first = F.min_by("q_start", F.struct(*order))
    got = t.groupBy("read_id", "chr", "island").agg(F.first("strand").alias("strand"), F.min("pos").alias("_a"), F.max("pos").alias("_b"), F.sum("len").alias("len"), first.alias("q_start"))
    return got.select("read_id", "chr", "strand", ((F.col("_a") + F.col("_b")) / 2).cast("bigint").alias("pos"), "len", "q_start")


def merge_deletions(rows: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """Deletions of a read and contig that begin within merge_del of the last one's end become one. read_id, chr, pos, len."""
    t = islands(rows, ["read_id", "chr"], ["pos", "ord"], lambda prev: F.col("pos") - prev(F.col("pos") + F.col("len")) > o.merge_del)
    return t.groupBy("read_id", "chr", "island").agg(F.min("pos").cast("bigint").alias("pos"), F.sum("len").alias("len")).drop("island")


def _wide(df: DataFrame, sv_type: str) -> DataFrame:
    have = set(df.columns)
    return df.select(F.lit(sv_type).alias("sv_type"), *((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in TYPES.items()), "read_id")


def all_insertions(near: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """Unmerged insertions from neighbouring pairs and across translocations."""
    pairs = insertion_pairs(colinear_pairs(near), o)
    jumps = across_translocation(near, o).filter("kind = 'INS'")
    return pairs.unionByName(jumps.select("read_id", "chr", "strand", F.lit(1).alias("src"), "ord", F.col("pos").cast("double").alias("pos"), "len", "q_start"))


def written_neighbours(segments: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """The neighbours that any rule can use (all look at a next segment), written once: rules that read the windows themselves would each sort all segments again, side by side in one task."""
    return materialise(neighbours(usable_segments(segments, o)).filter("s2 is not null"), "neighbours")


def signatures(segments: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """All signatures in the wide layout, without exact repeats."""
    near = written_neighbours(segments, o)
    parts = [
        _wide(merge_deletions(deletion_pairs(colinear_pairs(near), o), o), "DEL"),
        _wide(merge_insertions(all_insertions(near, o), o), "INS"),
        _wide(inversions(near, o), "INV"),
        _wide(translocations(near), "TRA"),
        _wide(across_translocation(near, o).filter("kind = 'DUP'").drop("strand"), "DUP"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates()
