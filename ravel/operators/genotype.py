"""Genotypes: read spans, reads that span a site without supporting its call, likelihoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravel.operators.rangejoin import containing
from ravel.operators.ranks import ranks
from ravel.plans.tables import materialise
from ravel.schema import CallOptions

_NEAR = 50_000


def read_spans(segments: DataFrame, min_seg_len: int = 300) -> DataFrame:
    """The longest reference interval that a read's segments make: chr, start, end, read_id.

    Segments are folded in the order (chr, rd_l): a forward one joins if it begins less than 50 kbp after the end so far, which becomes its
    end, a reverse one if it ends less than 50 kbp before the start so far, which becomes its start; else the interval closes. Segments
    under min_seg_len are passed over, but for the first. One shuffle by read; the fold is a higher-order function."""
    arr = F.array_sort(F.collect_list(F.struct("chr", "rd_l", "seg_idx", "rf_l", "rf_r", "strand", "seg_len")))
    g = segments.groupBy("read_id").agg(arr.alias("s"))
    state = "struct<chr:string,start:bigint,end:bigint,b_chr:string,b_start:bigint,b_end:bigint,b_len:bigint>"
    first = F.element_at("s", 1)
    zero = F.struct(first["chr"].alias("chr"), first["rf_l"].cast("bigint").alias("start"), first["rf_r"].cast("bigint").alias("end"), first["chr"].alias("b_chr"), first["rf_l"].cast("bigint").alias("b_start"), first["rf_r"].cast("bigint").alias("b_end"), F.lit(0).cast("bigint").alias("b_len")).cast(state)

    def state_of(chr_: Column, start: Column, end: Column, a: Column, close: Column) -> Column:
        better = close & (a["end"] - a["start"] > a["b_len"])
        return F.struct(chr_.alias("chr"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.when(better, a["chr"]).otherwise(a["b_chr"]).alias("b_chr"), F.when(better, a["start"]).otherwise(a["b_start"]).alias("b_start"), F.when(better, a["end"]).otherwise(a["b_end"]).alias("b_end"), F.when(better, a["end"] - a["start"]).otherwise(a["b_len"]).cast("bigint").alias("b_len")).cast(state)

    def step(a: Column, x: Column) -> Column:
        plus = x["strand"] == "+"
        joins = (x["chr"] == a["chr"]) & F.when(plus, x["rf_l"] - a["end"] < _NEAR).otherwise(a["start"] - x["rf_r"] < _NEAR)
        short = x["seg_len"] < min_seg_len
        start = F.when(short, a["start"]).when(joins & plus, a["start"]).otherwise(x["rf_l"])
        end = F.when(short, a["end"]).when(joins & ~plus, a["end"]).otherwise(x["rf_r"])
        return state_of(F.when(short, a["chr"]).otherwise(x["chr"]), start, end, a, ~short & ~joins)

    def done(a: Column) -> Column:
        last = a["end"] - a["start"] > a["b_len"]
        return F.struct(F.when(last, a["chr"]).otherwise(a["b_chr"]).alias("chr"), F.when(last, a["start"]).otherwise(a["b_start"]).alias("start"), F.when(last, a["end"]).otherwise(a["b_end"]).alias("end"))

    folded = g.select("read_id", F.aggregate(F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))), zero, step, done).alias("f"))
    return folded.select("f.chr", F.col("f.start").alias("start"), F.col("f.end").alias("end"), "read_id")


def unstranded_spans(segments: DataFrame, min_seg_len: int = 300) -> DataFrame:
    """The variant that orders by (chr, rf_l, rf_r) and joins every segment by the forward rule: islands, then the longest (the first of equals)."""
    from ravel.operators.islands import islands

    w = Window.partitionBy("read_id").orderBy("chr", "rf_l", "rf_r", "seg_idx")
    rows = segments.withColumn("_k", F.row_number().over(w)).filter((F.col("_k") == 1) | (F.col("seg_len") >= min_seg_len))
    rows = islands(rows, ["read_id"], ["_k"], lambda prev: (F.col("chr") != prev("chr")) | (F.col("rf_l") - prev("rf_r") >= _NEAR))
    each = rows.groupBy("read_id", "island").agg(F.first("chr").alias("chr"), F.min_by("rf_l", "_k").alias("start"), F.max_by("rf_r", "_k").alias("end"))
    best = each.groupBy("read_id").agg(F.max_by(F.struct("chr", "start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("island"))).alias("b"))
    return best.select("b.chr", F.col("b.start").alias("start"), F.col("b.end").alias("end"), "read_id")


def windows(calls: DataFrame, o: CallOptions = CallOptions()) -> DataFrame:
    """A row for each site of a call that reference reads must span: call_id, site, chr, win_start, win_end. INV has two sites."""
    p, half_inv = F.col("search_pos"), o.bias_inv / 2
    half_dup = F.least(F.lit(o.bias_dup), F.col("sv_len")) / 2
    by = {"DEL": (p - o.bias_del, p + o.bias_del), "INS": (p - 1000, p + 1000), "BND": (p - o.bias_tra, p + o.bias_tra), "DUP": (p - half_dup, p + half_dup), "INV": (p - half_inv, p + half_inv)}
    lo = hi = None
    for t, (a, b) in by.items():
        is_t = F.col("sv_type") == t
        lo, hi = (F.when(is_t, a), F.when(is_t, b)) if lo is None else (lo.when(is_t, a), hi.when(is_t, b))
    first = calls.select("call_id", F.lit(1).alias("site"), "chr", lo.alias("a"), hi.alias("b"))
    second = calls.filter("sv_type = 'INV'").select("call_id", F.lit(2).alias("site"), "chr", (F.col("pos2") - half_inv).alias("a"), (F.col("pos2") + half_inv).alias("b"))
    return first.union(second).select("call_id", "site", "chr", F.greatest(F.col("a"), F.lit(0)).cast("bigint").alias("win_start"), F.col("b").cast("bigint").alias("win_end"))


def spanning_reads(spans: DataFrame, wins: DataFrame, width: int = 10_000) -> DataFrame:
    """call_id, site, read_id of the reads whose span contains the window, each once."""
    return containing(spans, wins, "chr", width).select("call_id", "site", "read_id").distinct()


def ranked_spans(spans: DataFrame) -> DataFrame:
    """spans with rank (from 0) within their chr by (start, end, read_id), and of, how many the chr has."""
    out = ranks(spans.select("chr", "start", "end", "read_id"), ["chr"], ["start", "end", "read_id"], "rank")
    return out.join(out.groupBy("chr").agg(F.count(F.lit(1)).alias("of")), "chr")


def _probes(of: Column, upto: Column) -> Column:
    """The ranks that a search by halves looks at in `of` sorted rows if it never finds what it is looking for: right of a rank below `upto`, left of others."""
    state = F.struct(F.lit(0).cast("bigint").alias("low"), (of - 1).cast("bigint").alias("high"), F.array().cast("array<bigint>").alias("seen"))

    def step(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["low"] + a["high"], 1)
        open_ = a["low"] <= a["high"]
        left = mid >= upto
        return F.struct(F.when(open_ & ~left, mid + 1).otherwise(a["low"]).alias("low"), F.when(open_ & left, mid - 1).otherwise(a["high"]).alias("high"), F.when(open_, F.concat(a["seen"], F.array(mid))).otherwise(a["seen"]).alias("seen"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(of + 1)).cast("int"))
    return F.aggregate(steps, state, step, lambda a: a["seen"])


def _block(rank: str) -> Column:
    """Blocks of 64 ranks: about as many as a sample has, so it touches one or two."""
    return F.expr(f"({rank}) div 64")


def sampled_reads(spans: DataFrame, wins: DataFrame) -> DataFrame:
    """call_id, site, read_id: reads that span a window, of a sample by position. wins: call_id, site, chr, win_start, win_end, cap.

    A search by halves over the contig's spans in order of start finds one that overlaps the window; of the cap / 2 spans before it and the cap / 2
    from it on (the contig's very last is left out), those that begin by the window's end are looked at. All that the search can look at follows from how many spans
    begin by the window's end, so its ranks are joined at once, but for those beyond that number, which begin too late; the sample is joined as the few blocks of ranks that it
    touches. No contig is one task, whatever its depth."""
    table = materialise(ranked_spans(spans), "ranked")
    keys = ["call_id", "site"]
    # how many spans begin by each window's end: the rank of the window among the starts, without the windows before it
    both = table.select("chr", F.col("start").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("int").alias("site"))
    both = both.unionByName(wins.select("chr", F.col("win_end").alias("pos"), F.lit(1).alias("kind"), F.col("call_id").cast("string").alias("call_id"), F.col("site").cast("int").alias("site")))
    upto = ranks(both, ["chr"], ["pos", "kind", "call_id", "site"], "before", F.col("kind") == 0).filter("kind = 1").select("call_id", "site", "chr", "before")
    w = wins.select(F.col("call_id").cast("string").alias("call_id"), F.col("site").cast("int").alias("site"), "chr", "win_start", "win_end", "cap").join(upto, [*keys, "chr"])
    w = materialise(w.join(table.groupBy("chr").agg(F.first("of").alias("of")), "chr"), "windows")
    # places of the search stay numbered as they are looked at
    looks = w.select(*keys, "chr", "win_start", "win_end", "before", F.posexplode(_probes(F.col("of"), F.col("before"))).alias("k", "rank")).filter("rank < before").drop("before")
    hit = looks.join(table, ["chr", "rank"]).filter((F.col("start") <= F.col("win_end")) & (F.col("end") >= F.col("win_start")))
    mid = hit.groupBy(*keys).agg(F.min_by("rank", "k").alias("mid"))
    half = F.expr("cap div 2")
    lo = F.greatest(F.col("mid") - half, F.lit(0))
    hi = F.least(F.when(F.col("mid") + half >= F.col("of"), F.col("of") - 1).otherwise(F.col("mid") + half), F.col("before"))
    at = w.join(mid, keys).withColumn("lo", lo).withColumn("hi", hi).filter("lo < hi")
    at = at.select(*keys, "chr", "win_start", "win_end", "lo", "hi", F.explode(F.sequence(_block("lo"), _block("hi - 1"))).alias("block"))
    blocks = table.groupBy("chr", _block("rank").alias("block")).agg(F.collect_list(F.struct("rank", "start", "end", "read_id")).alias("rows"))

    def fits(x: Column) -> Column:
        return (x["rank"] >= F.col("lo")) & (x["rank"] < F.col("hi")) & (x["start"] < F.col("win_start")) & (x["end"] > F.col("win_end"))

    got = at.join(blocks, ["chr", "block"]).select(*keys, F.explode(F.filter("rows", fits)).alias("x")).select(*keys, "x.read_id")
    return got.select(*keys, "read_id").distinct()


def first_reads(spans: DataFrame, wins: DataFrame, width: int = 10_000) -> DataFrame:
    """call_id, site, reads, full: how many of the reads that span a window come before its cap is reached, in order of start. wins as in sampled_reads."""
    rows = containing(spans, wins, "chr", width).groupBy("call_id", "site", "cap", "read_id").agg(F.min(F.struct("start", "end")).alias("at"))
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("call_id", "site").orderBy("at", "read_id"))).filter(F.col("k") <= F.col("cap"))
    return ranked.groupBy("call_id", "site").agg(F.count(F.lit(1)).alias("reads"), (F.count(F.lit(1)) >= F.first("cap")).alias("full"))


def both_sites(spanning: DataFrame, wins: DataFrame) -> DataFrame:
    """call_id, read_id of the reads that span all sites of a call."""
    need = wins.groupBy("call_id").agg(F.count(F.lit(1)).alias("_need"))
    got = spanning.groupBy("call_id", "read_id").agg(F.count(F.lit(1)).alias("_got"))
    return got.join(need, "call_id").filter("_got = _need").select("call_id", "read_id")


def reference_reads(calls: DataFrame, found: DataFrame, wins: DataFrame) -> DataFrame:
    """call_id, dr: how many reads span all sites of a call and don't support it. found: call_id, site (under 63), read_id, a read perhaps more than once.

    Spanning and supporting reads are grouped together by call and read, in one shuffle: neither side is ever a hash table, which the driver would make of the second
    (its size is guessed from the file of calls, where names take little room)."""
    support = calls.select("call_id", F.lit(0).alias("site"), F.explode("read_ids").alias("read_id"))
    both = found.select("call_id", F.col("site").cast("int").alias("site"), "read_id").unionByName(support)
    got = both.groupBy("call_id", "read_id").agg(F.bit_or(F.expr("shiftleft(1L, site)")).alias("_sites"))
    spans = got.filter("_sites % 2 = 0").groupBy("call_id", F.bit_count("_sites").alias("_got")).agg(F.count(F.lit(1)).alias("dr"))
    need = wins.groupBy("call_id").agg(F.count(F.lit(1)).alias("_need"))
    return spans.join(need, "call_id").filter("_got = _need").select("call_id", "dr")


def ref_cap(n: Column) -> Column:
    """How many reads the capped mode looks at for n supporting ones."""
    return F.when(n <= 2, 10 * n).when(n <= 5, 5 * n).when(n <= 15, 4 * n).otherwise(3 * n)


def rescale(c0: Column, c1: Column, most: int = 100) -> tuple[Column, Column]:
    """Both counts, scaled to `most` together if they are more."""
    total = c0 + c1
    a = F.when(total > most, F.floor(most * (c0 / total)).cast("bigint")).otherwise(c0.cast("bigint"))
    return a, F.when(total > most, F.lit(most) - a).otherwise(c1.cast("bigint")).cast("bigint")


def likelihoods(c0: Column, c1: Column) -> Column:
    """struct(gt, pl, gq, qual) for c0 reference and c1 variant reads. Error 0.1, prior 1/3; the first of equal genotypes wins."""
    a, b = rescale(c0, c1)
    third = F.log10(F.lit(1 / 3))
    logs = [a * F.log10(F.lit(0.9)) + b * F.log10(F.lit(0.1)) + third, (a + b) * F.log10(F.lit(0.5)) + third, a * F.log10(F.lit(0.1)) + b * F.log10(F.lit(0.9)) + third]
    top = F.greatest(*logs)
    lse = top + F.log10(sum((F.pow(F.lit(10.0), x - top) for x in logs[1:]), F.pow(F.lit(10.0), logs[0] - top)))
    n = [F.least(x - lse, F.lit(0.0)) for x in logs]
    p = [F.pow(F.lit(10.0), x) for x in n]
    pl = [F.bround(-10 * x, 0).cast("bigint") for x in n]
    gq = [(-10 * F.log10(p[i] + p[j])).cast("bigint") for i, j in ((1, 2), (0, 2), (0, 1))]
    gt = F.when((n[0] >= n[1]) & (n[0] >= n[2]), "0/0").when(n[1] >= n[2], "0/1").otherwise("1/1")
    return F.struct(gt.alias("gt"), F.concat_ws(",", *(x.cast("string") for x in pl)).alias("pl"), F.greatest(*gq).alias("gq"), F.abs(F.bround(-10 * n[0], 1)).alias("qual"))


def genotyped(calls: DataFrame, spans: DataFrame, o: CallOptions = CallOptions(), width: int = 10_000) -> DataFrame:
    """calls (with call_id, read_ids) with dr, gt, pl, gq, qual; without genotyping the missing marks."""
    if not o.genotype:
        missing = {"dr": F.lit(None).cast("bigint"), "gt": F.lit("./."), "pl": F.lit(".,.,."), "gq": F.lit(None).cast("bigint"), "qual": F.lit(None).cast("double")}
        return calls.select("*", *(c.alias(k) for k, c in missing.items()))
    wins = windows(calls, o)
    if o.capped:
        caps = calls.select("call_id", ref_cap(F.size("read_ids")).alias("cap"))
        found = sampled_reads(spans, wins.join(caps, "call_id"))
    else:
        found = containing(spans, wins, "chr", width)
    out = calls.join(reference_reads(calls, found, wins), "call_id", "left").withColumn("dr", F.coalesce("dr", F.lit(0)).cast("bigint"))
    return out.withColumn("_g", likelihoods(F.col("dr"), F.size("read_ids"))).select(*out.columns, "_g.*")
