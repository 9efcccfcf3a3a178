"""VCF 4.2: header and body from calls, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravel.functions import vcf_format as V
from ravel.operators.ranks import ranks
from ravel.schema import CallOptions

# Order of the types among calls at one position, and the header lines of the format.
TYPE_RANK = ("DEL", "INS", "INV", "DUP", "BND")
HEADER_ALT = (
    ("INS", "Insertion of novel sequence relative to the reference"),
    ("DEL", "Deletion relative to the reference"),
    ("DUP", "Region of elevated copy number relative to the reference"),
    ("INV", "Inversion of reference sequence"),
    ("BND", "Breakend of translocation"),
)
HEADER_INFO = (
    ("PRECISE", "0", "Flag", "Precise structural variant"),
    ("IMPRECISE", "0", "Flag", "Imprecise structural variant"),
    ("SVTYPE", "1", "String", "Type of structural variant"),
    ("SVLEN", "1", "Integer", "Difference in length between REF and ALT alleles"),
    ("CHR2", "1", "String", "Chromosome for END coordinate in case of a translocation"),
    ("END", "1", "Integer", "End position of the variant described in this record"),
    ("CIPOS", "2", "Integer", "Confidence interval around POS for imprecise variants"),
    ("CILEN", "2", "Integer", "Confidence interval around inserted/deleted material between breakends"),
    ("RE", "1", "Integer", "Number of read support this record"),
    ("STRAND", "A", "String", "Strand orientation of the adjacency in BEDPE format (DEL:+-, DUP:-+, INV:++/--)"),
    ("RNAMES", ".", "String", "Supporting read names of SVs (comma separated)"),
)
HEADER_FORMAT = (
    ("GT", "1", "String", "Genotype"),
    ("DR", "1", "Integer", "# High-quality reference reads"),
    ("DV", "1", "Integer", "# High-quality variant reads"),
    ("PL", "G", "Integer", "# Phred-scaled genotype likelihoods rounded to the closest integer"),
    ("GQ", "1", "Integer", "# Genotype quality"),
)
COLUMNS = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "SAMPLE")


def fixed_header() -> list[str]:
    """The header lines that depend on nothing."""
    return [
        *(f'##ALT=<ID={i},Description="{d}">' for i, d in HEADER_ALT),
        *(f'##INFO=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in HEADER_INFO),
        '##FILTER=<ID=q5,Description="Quality below 5">',
        *(f'##FORMAT=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in HEADER_FORMAT),
    ]


def header(contigs: DataFrame, sample: str = "NULL", source: str = "ravel", command: str | None = None, date: str | None = None) -> DataFrame:
    """line_no, line. Contig lines stand in the order of contigs' column ord if it has one, else by name."""
    spark = contigs.sparkSession
    by = "ord" if "ord" in contigs.columns else "chr"
    first = ["##fileformat=VCFv4.2", f"##source={source}"] + ([f"##fileDate={date}"] if date else [])
    last = fixed_header() + ([f'##CommandLine="{command}"'] if command else []) + ["#" + "\t".join([*COLUMNS[:-1], sample])]
    a = spark.createDataFrame([(i - 1000, x) for i, x in enumerate(first)], "line_no bigint, line string")
    c = contigs.select(F.row_number().over(Window.orderBy(by)).cast("bigint").alias("line_no"), F.format_string("##contig=<ID=%s,length=%d>", "chr", "length").alias("line"))
    z = spark.createDataFrame([(i + (1 << 40), x) for i, x in enumerate(last)], "line_no bigint, line string")
    return a.union(c).union(z).select((F.row_number().over(Window.orderBy("line_no")) - 1).cast("bigint").alias("line_no"), "line")


def output_order() -> list[str | Column]:
    rank = F.array_position(F.array(*(F.lit(t) for t in TYPE_RANK)), F.col("sv_type"))
    return ["chr", "pos", rank, "pos2", "chr2", "sv_len", "orient", "alt", "support"]


def numbered(calls: DataFrame) -> DataFrame:
    """calls with n, from 0 for each type in output order, counted by ranges."""
    return ranks(calls, ["sv_type"], output_order(), "n")


def ordered(body: DataFrame) -> DataFrame:
    """records with line, from 1 in the order (CHROM, POS, ID): ranges of it are counted apart."""
    out = ranks(body.withColumn("_all", F.lit(0)), ["_all"], ["CHROM", "POS", "ID"], "line").drop("_all")
    return out.withColumn("line", (F.col("line") + 1).cast("bigint"))


def records(calls: DataFrame, o: CallOptions = CallOptions(), ref: Column | None = None, alt: Column | None = None) -> DataFrame:
    """The ten columns of each call. ref and alt: sequences instead of the symbols, which stand where one is null."""
    # names go along only where they are printed
    rows = numbered(calls if o.report_readid else calls.drop("read_ids"))
    c = {k: F.col(k) for k in rows.columns}
    symbol = F.when(c["sv_type"] == "BND", c["alt"]).otherwise(F.concat(F.lit("<"), c["sv_type"], F.lit(">")))
    return rows.select(
        c["chr"].alias("CHROM"), (c["pos"] + 1).alias("POS"), F.concat_ws(".", F.lit(o.id_prefix), c["sv_type"], c["n"].cast("string")).alias("ID"),
        (F.lit("N") if ref is None else F.coalesce(ref, F.lit("N"))).alias("REF"), (symbol if alt is None else F.coalesce(alt, symbol)).alias("ALT"),
        V.dot(c["qual"]).alias("QUAL"), V.filter_label(c["qual"]).alias("FILTER"), V.info(c, o.report_readid).alias("INFO"), F.lit("GT:DR:DV:PL:GQ").alias("FORMAT"), V.sample_column(c).alias("SAMPLE"),
    )


def write(calls: DataFrame, contigs: DataFrame, path: str, o: CallOptions = CallOptions(), ref: Column | None = None, alt: Column | None = None, **kw) -> None:
    """A folder of text files that are one VCF in the order of their names: the header in the first, then the records by (CHROM, POS, ID), sorted by ranges in
    as many tasks as there is data for. ref and alt: sequences of calls, as in records."""
    body = records(calls, o, ref, alt)
    lines = header(contigs, o.sample, **kw).select(F.lit(0).alias("a"), F.col("line_no").alias("b"), F.lit("").alias("c"), F.lit(0).cast("bigint").alias("d"), "line")
    lines = lines.union(body.select(F.lit(1), F.lit(0).cast("bigint"), "CHROM", "POS", F.concat_ws("\t", *(F.col(x).cast("string") for x in COLUMNS))))
    lines.orderBy("a", "b", "c", "d", "line").select("line").write.text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a VCF's records, POS as bigint, header lines left out."""
    rows = spark.read.text(path).filter((F.col("value") != "") & ~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    return rows.select(*(F.get("f", F.lit(i)).try_cast("bigint" if n == "POS" else "string").alias(n) for i, n in enumerate(COLUMNS)))
