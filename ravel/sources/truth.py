"""Truth sets: simulated events as BED rows, genotype classes by contig."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravel.schema import TRUTH_BED

# Event kinds of the truth files and their types.
KINDS = {"insertion": "INS", "deletion": "DEL", "inversion": "INV", "tandem duplication": "DUP", "reciprocal translocation": "BND"}


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema(TRUTH_BED).csv(path)


def explode_truth(bed: DataFrame) -> DataFrame:
    """sv_type, chr, start, end, sv_len, chr2, pos2, form: one row an event, one to four break ends a translocation.

    A translocation's payload is h:chr2:start2:strand1:strand2; with shift = end - start and forward strands on both sides it breaks at
    (start, start2) and (end, start2 + shift); other strands give the listed combinations."""
    kind = F.col("kind")
    t = None
    for k, v in KINDS.items():
        t = F.when(kind == k, v) if t is None else t.when(kind == k, v)
    p = F.split("payload", ":")
    s, e = F.col("start"), F.col("end")
    low, high = F.get(p, F.lit(2)).try_cast("bigint"), F.get(p, F.lit(2)).try_cast("bigint") + e - s
    f1, f2 = F.get(p, F.lit(3)).startswith("f"), F.get(p, F.lit(4)).startswith("f")

    def ends(*x: tuple[Column, Column, str]) -> Column:
        return F.array(*(F.struct(a.alias("start"), b.alias("pos2"), F.lit(c).alias("form")) for a, b, c in x))

    bnd = (
        F.when(f1 & f2, ends((s, low, "N[["), (e, high, "N[[")))
        .when(f1, ends((s, low, "N[["), (s, high, "[[N"), (e, low, "N]]"), (e, high, "]]N")))
        .when(f2, ends((s, high, "N]]"), (s, low, "]]N"), (e, low, "[[N"), (e, high, "N[[")))
        .otherwise(ends((s, high, "N]]"), (e, low, "N]]")))
    )
    other = F.array(F.struct(s.alias("start"), F.lit(None).cast("bigint").alias("pos2"), F.lit(None).cast("string").alias("form")))
    rows = bed.withColumn("sv_type", t).filter("sv_type IS NOT NULL").withColumn("_b", F.explode(F.when(F.col("sv_type") == "BND", bnd).otherwise(other)))
    size = F.when(F.col("sv_type") == "INS", F.length("payload").cast("bigint")).when(F.col("sv_type") != "BND", e - s + 1)
    return rows.select("sv_type", "chr", F.col("_b.start").alias("start"), F.when(F.col("sv_type").isin("DEL", "INV", "DUP"), e).alias("end"), size.alias("sv_len"), F.when(F.col("sv_type") == "BND", p[1]).alias("chr2"), F.col("_b.pos2").alias("pos2"), F.col("_b.form").alias("form"))


def genotype_class(purity: Column) -> Column:
    """hom over 80 %, het over 20 %, else none."""
    return F.when(purity > 80.0, "hom").when(purity > 20.0, "het").otherwise("None")


def read_genotypes(spark: SparkSession, path: str) -> DataFrame:
    """chr, genotype: of each contig the class of its last row's last column. Such files have a row a contig, in file order."""
    rows = spark.read.text(path).filter("value <> ''").select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("k"))
    rows = rows.select(F.col("f")[0].alias("chr"), F.element_at("f", -1).try_cast("double").alias("purity"), "k")
    return rows.groupBy("chr").agg(F.max_by("purity", "k").alias("purity")).select("chr", genotype_class(F.col("purity")).alias("genotype"))
