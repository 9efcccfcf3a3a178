"""A stored index: built once, joined many times without being shuffled.

The lookup table of a reference is a bucketed and sorted table of the session's catalog (the warehouse is shared), bucketed by seed. A join with
seeds shuffles the seeds to its buckets and reads the table where it lies. A second table of one row says what it was built from: the format's version, both
k-mer lengths, both limits, and a digest of the reference that does not depend on how it was cut or ordered. open_index() refuses an index of other values, and
an index whose row is missing, as it is written last, was never finished.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravel.functions.dna import kmer_code
from ravel.operators.extension import tiles
from ravel.operators.unipaths import lookup_table
from ravel.schema import AlignOptions

VERSION = 1


def digest(reference: DataFrame) -> str:
    """A number of contents: sums over tiles of two hashes of (chr, place, letters), with letters and contigs."""
    t = tiles(reference.withColumn("seq", F.upper("seq")), 4096, 0)
    hashes = (F.sum(F.xxhash64("chr", "tile", "seq", F.lit(i)).cast("decimal(38,0)")) for i in (1, 2))
    row = t.agg(F.sum(F.length("seq")), F.count_distinct("chr"), *hashes).first()
    return ":".join(str(x) for x in row)


def _values(reference: DataFrame, o: AlignOptions, index_k: int) -> dict:
    return {"version": VERSION, "index_k": index_k, "k": o.k, "max_unipath": o.max_unipath, "max_copies": o.max_copies, "digest": digest(reference)}


def build_index(reference: DataFrame, name: str, o: AlignOptions = AlignOptions(), index_k: int = 22, buckets: int = 64) -> None:
    """Write the index `name` of reference (chr, seq, perhaps at). An index of that name must not be there."""
    spark = reference.sparkSession
    if spark.catalog.tableExists(name):
        raise ValueError(f"there is a table {name} already")
    rows = lookup_table(reference.withColumn("seq", F.upper("seq")), max(index_k, o.k), o.k, o.max_unipath, o.max_copies)
    rows = rows.withColumn("kmer", kmer_code(F.col("kmer")))
    rows.repartition(buckets, "kmer").write.bucketBy(buckets, "kmer").sortBy("kmer").format("parquet").saveAsTable(name)
    spark.createDataFrame([_values(reference, o, index_k)], "version int, index_k int, k int, max_unipath int, max_copies int, digest string").write.format("parquet").saveAsTable(f"{name}_made")


def open_index(spark: SparkSession, name: str, reference: DataFrame, o: AlignOptions = AlignOptions(), index_k: int = 22) -> DataFrame:
    """kmer, chr, pos of the stored index. ValueError if it was never finished or built from another reference or with other options."""
    if not spark.catalog.tableExists(f"{name}_made"):
        raise ValueError(f"there is no finished index {name}")
    made, want = spark.table(f"{name}_made").first().asDict(), _values(reference, o, index_k)
    if made != want:
        raise ValueError("the index differs in " + ", ".join(k for k in want if made.get(k) != want[k]))
    return spark.table(name)


def drop_index(spark: SparkSession, name: str) -> None:
    for t in (f"{name}_made", name):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
