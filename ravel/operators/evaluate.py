"""Evaluation of calls against a truth set: band and overlap joins, match levels, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravel.operators.rangejoin import band, overlapping
from ravel.plans.tables import materialise


def info_fields(info: Column) -> dict[str, Column]:
    """svlen, end, re (absolute, 0 if absent or no number), svtype (three letters), chr2."""
    m = F.str_to_map(info, F.lit(";"), F.lit("="))

    def number(k: str) -> Column:
        return F.coalesce(F.abs(F.try_element_at(m, F.lit(k)).try_cast("double").cast("bigint")), F.lit(0))

    return {"svlen": number("SVLEN"), "end": number("END"), "re": number("RE"), "svtype": F.substring(F.coalesce(F.try_element_at(m, F.lit("SVTYPE")), F.lit("")), 1, 3), "chr2": F.coalesce(F.try_element_at(m, F.lit("CHR2")), F.lit(""))}


def genotype_class(sample: Column) -> Column:
    gt = F.split(sample, ":")[0]
    return F.when(gt.isin("0/1", "1/0"), "het").when(gt == "1/1", "hom").otherwise("unknown")


def breakend(alt: Column) -> dict[str, Column]:
    """chr2, pos2 and form of a break end's ALT."""
    inside = F.regexp_extract(alt, r"[\[\]]([^\[\]]+)[\[\]]", 1)
    form = F.when(alt.startswith("]"), "]]N").when(alt.startswith("["), "[[N").when(F.substring(alt, 2, 1) == "]", "N]]").otherwise("N[[")
    return {"chr2": F.split(inside, ":")[0], "pos2": F.get(F.split(inside, ":"), F.lit(1)).try_cast("bigint"), "form": form}


def parse_calls(vcf: DataFrame, types: list[str]) -> DataFrame:
    """id, sv_type, chr, pos, end, sv_len, chr2, pos2, form, gt of the records of vcf (the columns of sources.vcf.read) of the wanted types.

    With three types duplications count as insertions. A break end's two sides stand in the numeric order of their contigs if both are numbers."""
    f = info_fields(F.col("INFO"))
    rows = vcf.select("CHROM", "POS", "ID", "ALT", "SAMPLE", *(c.alias(k) for k, c in f.items()))
    if len(types) == 3:
        rows = rows.withColumn("svtype", F.when(F.col("svtype") == "DUP", "INS").otherwise(F.col("svtype")))
    rows = rows.filter(F.col("svtype").isin(*types))
    b = breakend(F.col("ALT"))
    bnd = F.col("svtype") == "BND"
    rows = rows.withColumn("_c2", F.when(F.col("end") == 0, b["chr2"]).otherwise(F.col("chr2"))).withColumn("_p2", F.when(F.col("end") == 0, b["pos2"]).otherwise(F.col("end")))
    turn = bnd & F.coalesce(F.col("CHROM").try_cast("bigint") > F.col("_c2").try_cast("bigint"), F.lit(False))
    size = F.when(F.col("svlen") == 0, F.col("end") - F.col("POS") + 1).otherwise(F.col("svlen"))
    return rows.select(
        F.col("ID").alias("id"), F.col("svtype").alias("sv_type"), F.when(turn, F.col("_c2")).otherwise(F.col("CHROM")).alias("chr"), F.when(turn, F.col("_p2")).otherwise(F.col("POS")).alias("pos"),
        F.when(~bnd, F.col("end")).alias("end"), F.when(~bnd, size).alias("sv_len"), F.when(bnd, F.when(turn, F.col("CHROM")).otherwise(F.col("_c2"))).alias("chr2"),
        F.when(bnd, F.when(turn, F.col("POS")).otherwise(F.col("_p2"))).alias("pos2"), F.when(bnd, b["form"]).alias("form"), genotype_class(F.col("SAMPLE")).alias("gt"),
    )


def other_types(vcf: DataFrame, types: list[str]) -> DataFrame:
    """sv_type, n of the records of other types."""
    kind = info_fields(F.col("INFO"))["svtype"]
    rows = vcf.select((F.when(kind == "DUP", "INS").otherwise(kind) if len(types) == 3 else kind).alias("sv_type"))
    return rows.filter(~F.col("sv_type").isin(*types)).groupBy("sv_type").agg(F.count(F.lit(1)).alias("n"))


def _ratio_ok(a: str, b: str, least: float) -> Column:
    return F.least(a, b) / F.greatest(a, b) >= least


def _sides(calls: DataFrame, truth: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    c = calls.filter(F.col("sv_type").isin(*types)).select("call_no", "sv_type", "chr", F.col("pos").alias("c_pos"), F.col("end").alias("c_end"), F.col("sv_len").alias("c_len"), F.col("chr2").alias("c_chr2"), F.col("pos2").alias("c_pos2"), "gt")
    t = truth.filter(F.col("sv_type").isin(*types)).select("truth_no", "sv_type", "chr", F.col("start").alias("t_pos"), F.col("end").alias("t_end"), F.col("sv_len").alias("t_len"), F.col("chr2").alias("t_chr2"), F.col("pos2").alias("t_pos2"))
    return c, t


def match_insertions(calls: DataFrame, truth: DataFrame, ratio: float = 0.7, offset: int = 1000, any_type: bool = False) -> DataFrame:
    """call_no, truth_no, chr, gt of insertions within offset of one of like length. any_type: against events of every type."""
    c, t = _sides(calls, truth, ["INS"])
    if any_type:
        _, t = _sides(calls, truth, ["INS", "DEL", "INV", "DUP"])
        t = t.withColumn("sv_type", F.lit("INS"))
    return band(c, t, ["sv_type", "chr"], "c_pos", "t_pos", offset).filter(_ratio_ok("c_len", "t_len", ratio)).select("call_no", "truth_no", "sv_type", "chr", F.lit(None).cast("string").alias("chr2"), "gt")


def match_breakends(calls: DataFrame, truth: DataFrame, offset: int = 1000) -> DataFrame:
    """Break ends whose two sides are both within offset; orientation doesn't matter."""
    c, t = _sides(calls, truth, ["BND"])
    c, t = c.withColumn("chr2", F.col("c_chr2")), t.withColumn("chr2", F.col("t_chr2"))
    return band(c, t, ["sv_type", "chr", "chr2"], "c_pos", "t_pos", offset).filter(F.abs(F.col("c_pos2") - F.col("t_pos2")) <= offset).select("call_no", "truth_no", "sv_type", "chr", "chr2", "gt")


def match_overlaps(calls: DataFrame, truth: DataFrame, ratio: float = 0.7, offset: int = 1000, width: int = 10_000) -> DataFrame:
    """Deletions, inversions and duplications that overlap, after offset on both sides of the call, one of like length."""
    c, t = _sides(calls, truth, ["DEL", "INV", "DUP"])
    c = c.withColumn("_a", F.col("c_pos") - offset).withColumn("_b", F.col("c_end") + offset)
    return overlapping(c.filter("_a <= _b"), t.filter("t_pos <= t_end"), ["sv_type", "chr"], width, ("_a", "_b"), ("t_pos", "t_end")).filter(_ratio_ok("c_len", "t_len", ratio)).select("call_no", "truth_no", "sv_type", "chr", F.lit(None).cast("string").alias("chr2"), "gt")


def matches(calls: DataFrame, truth: DataFrame, ratio: float = 0.7, offset: int = 1000, dup_truth: bool = False) -> DataFrame:
    """All matching pairs. dup_truth: insertions against events of every type, for truth sets without insertions."""
    return match_insertions(calls, truth, ratio, offset, dup_truth).unionByName(match_breakends(calls, truth, offset)).unionByName(match_overlaps(calls, truth, ratio, offset))


def levels(pairs: DataFrame, genotypes: DataFrame) -> DataFrame:
    """pairs with level: 1 for the position, 2 for the genotype of the contig (either contig of a break end) as well."""
    g1 = genotypes.select("chr", F.col("genotype").alias("_g1"))
    g2 = genotypes.select(F.col("chr").alias("chr2"), F.col("genotype").alias("_g2"))
    j = pairs.join(g1, "chr", "left").join(g2, "chr2", "left")
    ok = F.coalesce(F.col("gt") == F.col("_g1"), F.lit(False)) | F.coalesce(F.col("gt") == F.col("_g2"), F.lit(False))
    return j.withColumn("level", F.when(ok, 2).otherwise(1)).drop("_g1", "_g2")


def precision_recall(calls: DataFrame, truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """sv_type, side (precision over calls, recall over events), n, hit_1, hit_2, rate_1, rate_2. pairs: with level."""

    def side(rows: DataFrame, key: str, name: str) -> DataFrame:
        best = pairs.groupBy(key).agg(F.max("level").alias("level"))
        j = rows.select(key, "sv_type").join(best, key, "left").withColumn("level", F.coalesce("level", F.lit(0)))
        n = F.count(F.lit(1))
        hits = [F.sum((F.col("level") >= k).cast("bigint")) for k in (1, 2)]
        return j.groupBy("sv_type").agg(F.lit(name).alias("side"), n.alias("n"), hits[0].alias("hit_1"), hits[1].alias("hit_2"), (hits[0] / n).alias("rate_1"), (hits[1] / n).alias("rate_2"))

    return side(calls, "call_no", "precision").unionByName(side(truth, "truth_no", "recall"))


# The types that each evaluation mode looks at.
MODES = {"IID": ["INS", "INV", "DEL"], "DUP": ["INS", "DUP"], "BND": ["BND"]}


def compare(callsets: dict[str, DataFrame], truth: DataFrame, genotypes: DataFrame, mode: str = "IID", ratio: float = 0.7, offset: int = 1000) -> DataFrame:
    """precision_recall of several call sets (name -> columns of sources.vcf.read) side by side, with a column caller; truth counts with the
    types of the mode."""
    truth = truth.filter(F.col("sv_type").isin(*MODES[mode]))
    out = None
    for name, vcf in callsets.items():
        # written, so that both sides see the same numbers
        calls = materialise(parse_calls(vcf, MODES[mode]).withColumn("call_no", F.monotonically_increasing_id()), "parsed")
        pairs = levels(matches(calls, truth, ratio, offset, mode == "DUP"), genotypes)
        r = precision_recall(calls, truth, pairs).withColumn("caller", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out
