"""The skeleton aligner: k-mer index, seeds, anchors, chains, segments.

Index, seeds, the frequency prune, diagonal merges and strand choice are joins and windows. Three steps are sequential in nature and run as Arrow functions
over one read's rows: chaining, the block extension, and overlap suppression. The reference is held as overlapping tiles, so no
row ever holds a chromosome.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravel.functions.dna import clean_runs, kmer_code, kmers_of, reverse_complement
from ravel.operators.blocks import extend_blocks
from ravel.operators.extension import asked
from ravel.operators.islands import islands
from ravel.operators.seeding import seed_walk
from ravel.operators.streams import by_key
from ravel.operators.unipaths import lookup_table
from ravel.plans.tables import materialise
from ravel.schema import AlignOptions


def eligible_reads(reads: DataFrame, o: AlignOptions = AlignOptions()) -> DataFrame:
    """Reads of at least min_read_len letters with a run without N longer than k; usable: the letters of such runs."""
    runs = clean_runs(F.col("seq"), o.k)
    n = F.length("seq")
    # nearly all reads are one run, which needs no copy
    usable = F.when(F.col("seq").contains("N") | F.col("seq").contains("n"), F.aggregate(runs, F.lit(0), lambda a, x: a + F.length(x))).otherwise(F.when(n >= o.k, n).otherwise(0))
    return reads.withColumn("usable", usable.cast("bigint")).filter((F.length("seq") >= o.min_read_len) & (F.col("usable") > o.k))


def kmer_index(reference: DataFrame, k: int = 22, step: int = 1, clean: bool = True) -> DataFrame:
    """chr, pos (from 1), kmer of every position of reference (chr, seq), optionally with an offset column `at` of the tile."""
    at = F.col("at") if "at" in reference.columns else F.lit(0).cast("bigint")
    out = reference.select("chr", at.alias("_at"), F.explode(kmers_of(F.col("seq"), k, 1, step)).alias("k")).select("chr", (F.col("k.pos") + F.col("_at")).alias("pos"), F.col("k.kmer").alias("kmer"))
    out = out.filter(F.col("kmer").rlike("^[ACGT]+$")) if clean else out
    return out.distinct() if "at" in reference.columns else out


def frequency_prune(index: DataFrame, max_copies: int) -> DataFrame:
    """index without k-mers that occur more than max_copies times. Counts are summed before the shuffle."""
    rare = index.groupBy("kmer").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") <= max_copies)
    return index.join(rare, "kmer")


def seed_zones(length: Column, o: AlignOptions = AlignOptions()) -> Column:
    """Array of (zone, pos from 1, cap) of a run's seed positions: a head and a tail of 100 with stride 10 and at most 3 hits, if the run
    has 300 or more, and a middle with stride seed_step. The first seed is at offset 20; a zone begins where the last one stopped."""
    k, step = o.k, max(5, o.seed_step)
    long = length >= 300
    head_n = F.when(long, F.greatest(F.lit(0), F.ceil((F.lit(100 - k - 20)) / 10))).otherwise(0).cast("int")
    mid_from = F.when(long, 20 + 10 * head_n).otherwise(20).cast("int")
    mid_len = F.when(long, length - 200).otherwise(length)
    mid_end = F.when(long, length - 100).otherwise(length)
    mid_n = F.greatest(F.lit(0), F.ceil((mid_end - k - mid_from) / step)).cast("int")
    tail_from = (mid_from + mid_n * step).cast("int")
    tail_n = F.when(long, F.greatest(F.lit(0), F.ceil((length - k - tail_from) / 10))).otherwise(0).cast("int")

    def zone(name: str, start: Column, n: Column, stride: int, cap: Column) -> Column:
        empty = F.array().cast("array<struct<zone:string,pos:bigint,cap:bigint>>")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.lit(name).alias("zone"), (start + i * stride + 1).cast("bigint").alias("pos"), cap.cast("bigint").alias("cap")))).otherwise(empty)

    return F.concat(zone("head", F.lit(20), head_n, 10, F.lit(3)), zone("middle", mid_from, mid_n, step, F.floor(mid_len / step)), zone("tail", tail_from, tail_n, 10, F.lit(3)))


def seeds(reads: DataFrame, o: AlignOptions = AlignOptions(), clean: bool = True) -> DataFrame:
    """read_id, zone, pos, cap, kmer: the sampled k-mers of reads (read_id, seq); with clean, of each maximal run of letters other than N."""
    if clean:
        # positions of the runs: length of what was before each one
        parts = F.split(F.upper("seq"), "(?<=N)(?=[^N])|(?<=[^N])(?=N)")
        rows = reads.select("read_id", F.posexplode(parts).alias("i", "run"), F.transform(parts, lambda x: F.length(x)).alias("n"))
        rows = rows.select("read_id", "run", F.aggregate(F.slice("n", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + x).alias("at")).filter((F.length("run") >= o.k) & ~F.col("run").startswith("N"))
    else:
        rows = reads.select("read_id", F.col("seq").alias("run"), F.lit(0).alias("at"))
    # k-mers are taken from short pieces, as the cost of a substring grows with its place in a text, and before the rows are exploded
    width = 1024
    n = F.length("run")
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / width).cast("int")), lambda i: F.substring(F.col("run"), i * width + 1, F.lit(width + o.k)))
    rows = rows.select("read_id", "at", n.alias("n"), F.posexplode(pieces).alias("j", "piece"))
    own = F.filter(seed_zones(F.col("n"), o), lambda z: F.floor((z["pos"] - 1) / width) == F.col("j"))
    made = F.transform(own, lambda z: F.struct(z["zone"].alias("zone"), z["pos"].alias("pos"), z["cap"].alias("cap"), F.substring(F.col("piece"), (z["pos"] - F.col("j") * width).cast("int"), F.lit(o.k)).alias("kmer")))
    out = rows.select("read_id", "at", F.explode(made).alias("s"))
    out = out.select("read_id", "s.zone", (F.col("s.pos") + F.col("at")).alias("pos"), "s.cap", F.col("at").cast("bigint").alias("run_at"), "s.kmer")
    return out.filter(F.col("kmer").rlike("^[ACGT]+$")) if clean else out


def seed_join(sampled: DataFrame, index: DataFrame) -> DataFrame:
    """read_id, chr, rd (from 1), rf (from 1): where sampled k-mers occur in the (pruned) index, at most `cap` seeds with hits a zone."""
    hits = sampled.join(index.select("kmer", "chr", F.col("pos").alias("rf")), "kmer").withColumnRenamed("pos", "rd")
    w = Window.partitionBy("read_id", "run_at", "zone").orderBy("rd")
    return hits.withColumn("_k", F.dense_rank().over(w)).filter(F.col("_k") <= F.col("cap")).select("read_id", "chr", "rd", "rf")


def diagonal_merge(hits: DataFrame, k: int, reach: int = 0) -> DataFrame:
    """Anchors from hits: hits of one diagonal (rf - rd) that overlap or touch (or lie `reach` apart) become one exact match."""
    rows = hits.withColumn("diag", F.col("rf") - F.col("rd"))
    rows = islands(rows, ["read_id", "chr", "diag"], ["rd"], lambda prev: F.col("rd") - prev("rd") > k + reach)
    out = rows.groupBy("read_id", "chr", "diag", "island").agg(F.min("rd").alias("rd_l"), (F.max("rd") + k - 1).alias("rd_r"), F.min("rf").alias("rf_l"), (F.max("rf") + k - 1).alias("rf_r"))
    return out.withColumn("len", F.col("rd_r") - F.col("rd_l") + 1).drop("diag", "island")


def anchor_score(length: Column, errors: Column, genome: float, o: AlignOptions = AlignOptions()) -> Column:
    """Log-odds (times 10) that a match of that length with that many errors is no chance hit in a genome of that size."""
    hit = sum(o.errors())
    per_match = -10 * math.log10(0.25 / (1 - hit))
    per_error = -10 * math.log10(0.75 / hit)
    return (length - errors) * per_match + errors * per_error - 10 * math.log10(genome)


def good_anchors(anchors: DataFrame, genome: float, o: AlignOptions = AlignOptions()) -> DataFrame:
    least = o.k + 2 * o.edit_dis + 7
    rows = anchors.withColumn("score", anchor_score(F.col("len"), F.lit(0), genome, o))
    return rows.filter((F.col("len") >= least) & (F.col("score") >= least))


def best_chains(a: np.ndarray, chrom: np.ndarray, o: AlignOptions) -> list[tuple[int, list[int]]]:
    """(score, anchors in order) of up to top_n chains without common anchors. a: columns rd_l, rd_r, rf_l, rf_r, in read order.

    A chain's score is the first anchor's length plus, for each next one, the new letters it brings less the drift between the two. An anchor may
    follow one that begins and ends before it on read and reference, at most the gap limits away; the nearest max_predecessors such are tried.
    A later chain that overlaps the first on the read by more than overlap_ratio of either counts only from secondary_ratio of its score."""
    n = len(a)
    free = np.ones(n, bool)
    found: list[tuple[int, list[int]]] = []
    first: tuple[int, int, int] | None = None
    for _ in range(o.top_n):
        score = np.where(free, a[:, 1] - a[:, 0] + 1, -1).astype(np.int64)
        back = np.full(n, -1)
        for i in range(n):
            if not free[i]:
                continue
            j = np.flatnonzero(free[:i] & (chrom[:i] == chrom[i]) & (a[:i] < a[i]).all(1) & (a[i, 0] - a[:i, 1] < o.rd_mx_gap) & (a[i, 2] - a[:i, 3] < o.rf_mx_gap))[::-1][: o.max_predecessors]
            if not len(j):
                continue
            rd, rf = a[i, 0] - a[j, 1], a[i, 2] - a[j, 3]
            new = np.minimum(np.where(rd > 0, a[i, 1] - a[i, 0], a[i, 1] - a[j, 1]), np.where(rf > 0, a[i, 3] - a[i, 2], a[i, 3] - a[j, 3])) + 1
            total = score[j] + new - np.abs(rd - rf)
            best = int(np.argmax(total))
            if total[best] > score[i]:
                score[i], back[i] = total[best], j[best]
        top = int(np.argmax(score)) if n else -1
        if top < 0 or not free[top] or score[top] < o.min_chain_score:
            break
        path, k = [], top
        while k >= 0:
            path.append(int(k))
            free[k] = False
            k = back[k]
        path.reverse()
        lo, hi = int(a[path[0], 0]), int(a[path[-1], 1])
        if first is None:
            first = (int(score[top]), lo, hi)
        else:
            common = min(hi, first[2]) - max(lo, first[1])
            over = common >= 0 and (common > o.overlap_ratio * (hi - lo) or common > o.overlap_ratio * (first[2] - first[1]))
            if over and score[top] < o.secondary_ratio * first[0]:
                continue
        found.append((int(score[top]), path))
    return found


def chain_top_n(anchors: DataFrame, o: AlignOptions = AlignOptions()) -> DataFrame:
    """read_id, strand, chain (from 0), score, ord and the anchor, for the best chains of every read and strand."""

    def work(g: dict[str, np.ndarray]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("read_id", "strand", "chain", "score", "ord", "chr", "rd_l", "rd_r", "rf_l", "rf_r")}
        for c, (score, path) in enumerate(best_chains(np.stack([g[x] for x in ("rd_l", "rd_r", "rf_l", "rf_r")], 1), g["chr"], o)):
            for x in ("read_id", "strand", "chr", "rd_l", "rd_r", "rf_l", "rf_r"):
                out[x] += g[x][path].tolist()
            out["chain"] += [c] * len(path)
            out["score"] += [score] * len(path)
            out["ord"] += range(len(path))
        return out

    schema = "read_id string, strand string, chain bigint, score bigint, ord bigint, chr string, rd_l bigint, rd_r bigint, rf_l bigint, rf_r bigint"
    return by_key(anchors.select("read_id", "strand", "chr", "rd_l", "rd_r", "rf_l", "rf_r"), ["read_id", "strand"], ["rd_l", "rd_r", "chr", "rf_l"], work, schema)


def strand_select(scores: DataFrame, o: AlignOptions = AlignOptions()) -> DataFrame:
    """scores (read_id, strand, score: the best of the strand) with `primary`: the strand of the higher score, the reverse one of equals; rows
    of reads with no score of min_chain_score go."""
    best = F.max_by("strand", F.struct("score", F.when(F.col("strand") == "-", 1).otherwise(0))).over(Window.partitionBy("read_id"))
    top = F.max("score").over(Window.partitionBy("read_id"))
    return scores.withColumn("_top", top).withColumn("primary", best == F.col("strand")).filter(F.col("_top") >= o.min_chain_score).drop("_top")


def merge_segments(rows: DataFrame, o: AlignOptions = AlignOptions(), most_span: int = 60) -> DataFrame:
    """Neighbours of a chain (read_id, strand, chain) whose drift is at most sv_lim less twice the expected errors over their span, and
    which lie at most most_span apart, become one segment; one that lies inside what came before is absorbed."""
    ins, dele, _ = o.errors()
    w = Window.partitionBy("read_id", "strand", "chain").orderBy("rd_l", "rf_l").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_max_rd", F.max("rd_r").over(w)).withColumn("_max_rf", F.max("rf_r").over(w))
    rows = rows.filter(~F.coalesce((F.col("rd_r") <= F.col("_max_rd")) & (F.col("rf_r") <= F.col("_max_rf")), F.lit(False)))

    def breaks(prev) -> Column:
        rd, rf = F.col("rd_l") - prev("rd_r"), F.col("rf_l") - prev("rf_r")
        span = F.greatest(F.least(rd, rf), F.lit(0))
        return (F.col("chr") != prev("chr")) | (F.abs(rd - rf) > o.sv_lim - 2 * span * max(ins, dele)) | (span > most_span)

    rows = islands(rows, ["read_id", "strand", "chain"], ["rd_l", "rf_l"], breaks)
    out = rows.groupBy("read_id", "strand", "chain", "island").agg(F.first("chr").alias("chr"), F.min("rd_l").alias("rd_l"), F.max("rd_r").alias("rd_r"), F.min("rf_l").alias("rf_l"), F.max("rf_r").alias("rf_r"))
    return out.drop("island")


def clamp_to_contig(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """Segments cut at the ends of their contig (chr, length), read coordinates with them. Contigs are few, but their number has no bound, so Spark plans the join."""
    j = rows.join(contigs.select("chr", F.col("length").alias("_len")), "chr")
    lo, hi = F.greatest(1 - F.col("rf_l"), F.lit(0)), F.greatest(F.col("rf_r") - F.col("_len"), F.lit(0))
    return j.withColumn("rd_l", F.col("rd_l") + lo).withColumn("rd_r", F.col("rd_r") - hi).withColumn("rf_l", F.col("rf_l") + lo).withColumn("rf_r", F.col("rf_r") - hi).filter("rd_l <= rd_r AND rf_l <= rf_r").drop("_len")


def suppressed(primary: list[tuple[int, int]], other: list[tuple[int, int]]) -> tuple[list[bool], list[bool]]:
    """Which read intervals stay. In turn, each rule seeing what the ones before decided: an interval of the other strand that a valid primary one
    covers by more than 0.6 goes; a primary one that a valid one of the other strand covers by more than 0.8 goes; on each strand one
    that a later valid one covers by more than 0.8 goes."""

    def covered(x: tuple[int, int], by: tuple[int, int]) -> float:
        return max(0, min(x[1], by[1]) - max(x[0], by[0]) + 1) / max(1, x[1] - x[0] + 1)

    keep = [[True] * len(primary), [True] * len(other)]
    sides = [primary, other]
    for side, most in ((1, 0.6), (0, 0.8)):
        for i, x in enumerate(sides[side]):
            keep[side][i] = not any(keep[1 - side][j] and covered(x, y) > most for j, y in enumerate(sides[1 - side]))
    for side in (0, 1):
        for i, x in enumerate(sides[side]):
            if keep[side][i]:
                keep[side][i] = not any(keep[side][j] and covered(x, y) > 0.8 for j, y in list(enumerate(sides[side]))[i + 1 :])
    return keep[0], keep[1]


def overlap_suppress(rows: DataFrame) -> DataFrame:
    """Segments (read_id, strand, primary, chr, forward read coordinates) without those that others cover."""
    cols = ["read_id", "strand", "primary", "chr", "rd_l", "rd_r", "rf_l", "rf_r"]

    def work(g: dict[str, np.ndarray]) -> dict[str, list]:
        main = g["primary"].astype(bool)
        at = [np.flatnonzero(main), np.flatnonzero(~main)]
        keep = suppressed(*(list(zip(g["rd_l"][i].tolist(), g["rd_r"][i].tolist())) for i in at))
        stay = np.concatenate([i[np.array(k, bool)] for i, k in zip(at, keep)])
        return {c: g[c][stay].tolist() for c in cols}

    return by_key(rows.select(*cols), ["read_id"], ["rd_l", "rd_r", "chr", "rf_l", "rf_r", "strand"], work, "read_id string, strand string, primary boolean, chr string, rd_l bigint, rd_r bigint, rf_l bigint, rf_r bigint")


def forward_coordinates(rows: DataFrame) -> DataFrame:
    """Read coordinates from 0 on the forward read, for both strands; rows have read_len and coordinates from 1 on their own strand."""
    minus = F.col("strand") == "-"
    lo, hi = F.col("rd_l") - 1, F.col("rd_r") - 1
    return rows.withColumn("_a", F.when(minus, F.col("read_len") - 1 - hi).otherwise(lo)).withColumn("_b", F.when(minus, F.col("read_len") - 1 - lo).otherwise(hi)).withColumn("rd_l", F.col("_a")).withColumn("rd_r", F.col("_b")).drop("_a", "_b")


def interleave(rows: DataFrame) -> DataFrame:
    """Segments of both strands in the skeleton layout, numbered by rd_l."""
    w = Window.partitionBy("read_id").orderBy("rd_l", "strand", "rf_l", "chr")
    return rows.select("read_id", "read_len", (F.row_number().over(w) - 1).cast("bigint").alias("seg_idx"), "chr", "strand", "rd_l", "rd_r", "rf_l", "rf_r", (F.col("rd_r") + 1 - F.col("rd_l")).alias("seg_len"))


def align(reads: DataFrame, reference: DataFrame, o: AlignOptions = AlignOptions(), index: DataFrame | None = None) -> DataFrame:
    """Skeleton segments of reads (read_id, seq) on reference (chr, seq; with at its pieces, as sources.sequences.read_reference gives them). index: a stored one (sources/index_store.py), else it is made for this run."""
    o = o.clamped()
    reads = eligible_reads(reads.select("read_id", F.left("seq", F.lit(o.max_read_len)).alias("seq")), o).select("read_id", F.upper("seq").alias("seq"), F.length("seq").cast("bigint").alias("read_len"))
    # written: seeds, both extensions and the lengths read them
    reads = materialise(reads, "reads")
    both = reads.withColumn("strand", F.lit("+")).unionByName(reads.withColumn("seq", reverse_complement(F.col("seq"))).withColumn("strand", F.lit("-")))
    reference = reference.select(*(F.upper("seq").alias(c) if c == "seq" else c for c in ("chr", "at", "seq") if c in reference.columns))
    genome = float(reference.agg(F.sum(F.length("seq"))).first()[0] or 1)
    if index is None:
        index = materialise(lookup_table(reference, max(22, o.k), o.k, o.max_unipath, o.max_copies).withColumn("kmer", kmer_code(F.col("kmer"))), "index")
    anchors = seed_walk(both, index, reference, genome, o)
    chains = materialise(chain_top_n(anchors, o), "chains")
    best = strand_select(chains.groupBy("read_id", "strand").agg(F.max("score").alias("score")), o).select("read_id", "strand", "primary")
    segments = merge_segments(extend_blocks(merge_segments(chains, o), asked(both, chains, ["read_id", "strand"]), reference, o), o)
    segments = clamp_to_contig(segments, reference.groupBy("chr").agg(F.sum(F.length("seq")).alias("length"))).join(best, ["read_id", "strand"]).join(reads.select("read_id", "read_len"), "read_id")
    kept = overlap_suppress(forward_coordinates(segments)).join(reads.select("read_id", "read_len"), "read_id")
    return interleave(kept)
