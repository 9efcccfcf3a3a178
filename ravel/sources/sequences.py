"""FASTA, FASTQ, .fai, and reference tables. Compressed files are read through Spark's codecs.

A FASTA record is cut at "\\n>", so multi-line sequences need no window over the file; FASTQ takes four lines a record, found by cutting at
"\\n@" and keeping the pieces that have the four-line form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravel.functions.dna import reverse_complement, upper_bases
from ravel.operators.extension import tiles
from ravel.plans.tables import materialise
from ravel.schema import CONTIGS


def _records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return spark.read.option("lineSep", sep).text(path)


def _cut(seq: Column, most: int | None) -> Column:
    return seq if most is None else F.left(seq, F.lit(most))


def read_fasta(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """read_id (the name up to the first blank), seq (upper case, U as T), read_len. Records are whole, unless `most` says how many bases
    of each to keep."""
    rows = _records(spark, path, "\n>").select(F.regexp_replace("value", "^>", "").alias("v"))
    parts = F.split("v", "\r?\n", 2)
    seq = upper_bases(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "\\s", ""))
    out = rows.select(F.split(parts[0], "\\s")[0].alias("read_id"), _cut(seq, most).alias("seq")).filter("read_id <> ''")
    return out.withColumn("read_len", F.length("seq").cast("bigint"))


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """chr, at, seq of a FASTA file of any record length: its lines as pieces, `at` the bases of the record before them. A record may lie across any number of splits of the
    file: each split counts its own lines, and what runs on into it follows from one row a split. tiles(), the index and align take such pieces, so no row is
    ever a chromosome. Upper case, U as T; lines before the first name belong to no record."""
    m = F.col("_metadata")
    lines = spark.read.text(path).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"))
    seq = upper_bases(F.regexp_replace("value", "\\s", ""))
    head = F.col("value").startswith(">")
    name = F.when(head, F.split(F.substring("value", 2, 1 << 30), "\\s")[0])
    lines = materialise(lines.select("file", "block", "id", head.alias("head"), name.alias("name"), F.when(head, "").otherwise(seq).alias("seq")), "lines")
    split = Window.partitionBy("file", "block").orderBy("id")
    rows = lines.withColumn("part", F.sum(F.col("head").cast("int")).over(split)).withColumn("own", F.last("name", ignorenulls=True).over(split))
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("seq")).over(Window.partitionBy("file", "block", "part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a row a split: the record that it ends in, if it begins one, and the bases of it that it has
    ends = rows.groupBy("file", "block", "part").agg(F.max("own").alias("own"), F.sum(F.length("seq")).alias("n")).groupBy("file", "block").agg(F.max(F.struct("part", "own", "n")).alias("e"))
    file = Window.partitionBy("file").orderBy("block")
    ends = ends.select("file", "block", F.col("e.own").alias("own"), F.col("e.n").alias("n")).withColumn("run", F.count("own").over(file))
    ends = ends.withColumn("so_far", F.sum("n").over(Window.partitionBy("file", "run").orderBy("block")))
    earlier = file.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "block", F.last("own", ignorenulls=True).over(earlier).alias("from"), F.coalesce(F.lag("so_far").over(file), F.lit(0)).alias("had"))
    rows = rows.join(ends, ["file", "block"])
    first = F.col("part") == 0
    out = rows.select(F.coalesce("own", "from").alias("chr"), (F.col("before") + F.when(first, F.col("had")).otherwise(0)).cast("bigint").alias("at"), "seq")
    return out.filter("chr is not null AND seq <> ''")


def read_fastq(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """As read_fasta, from four-line records; qualities are dropped. A quality line that begins with @ is told from a name by the form of
    the record: name, bases, a line with +, and as many signs as bases."""
    lines = F.split(F.regexp_replace("value", "^@", ""), "\r?\n")
    rows = _records(spark, path, "\n@").select(lines.alias("l"))
    rows = rows.filter((F.size("l") >= 3) & F.get("l", F.lit(2)).startswith("+"))
    out = rows.select(F.split(F.col("l")[0], "\\s")[0].alias("read_id"), _cut(upper_bases(F.col("l")[1]), most).alias("seq"))
    return out.withColumn("read_len", F.length("seq").cast("bigint"))


def write_fasta(reads: DataFrame, path: str) -> None:
    reads.select(F.concat(F.lit(">"), F.col("read_id"), F.lit("\n"), F.col("seq"))).write.text(path)


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """chr, length and ord, a number that grows in the file's order of rows."""
    rows = spark.read.option("sep", "\t").schema("chr string, length bigint, a bigint, b bigint, c bigint").csv(path)
    return rows.select("chr", "length", F.monotonically_increasing_id().alias("ord"))


def contig_offsets(contigs: DataFrame) -> DataFrame:
    """contigs with `offset`, the bases of the contigs before, by name. Contigs are few, so one window is enough."""
    return contigs.withColumn("offset", F.coalesce(F.sum("length").over(Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def bases_at(calls: DataFrame, reference: DataFrame, pos: str, length: str, name: str, core: int = 4096) -> DataFrame:
    """calls with `name`: the reference (chr, seq, perhaps at) from 1-based pos over length bases. The reference comes as tiles: a call meets those that it touches and
    is put together from their parts, so no join carries a contig and a stretch may lie across any number of borders."""
    rows = calls.withColumn("_row", F.monotonically_increasing_id())
    rows = materialise(rows, "stretches")
    a, n = F.greatest(F.col(pos), F.lit(1)).cast("bigint"), F.greatest(F.col(length), F.lit(0)).cast("bigint")
    tile = F.explode(F.when(n > 0, F.sequence(F.floor((a - 1) / core).cast("int"), F.floor((a + n - 2) / core).cast("int"))))
    want = rows.select("_row", "chr", a.alias("_a"), n.alias("_n"), tile.alias("tile"))
    t = tiles(reference.select(*(c for c in ("chr", "at", "seq") if c in reference.columns)), core, 0)
    lo = F.greatest(F.col("_a") - 1, F.col("at")) - F.col("at")
    hi = F.least(F.col("_a") - 1 + F.col("_n"), F.col("at") + F.length("seq")) - F.col("at")
    parts = want.join(t, ["chr", "tile"]).select("_row", "tile", F.substring("seq", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")).alias("part"))
    made = parts.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("tile", "part"))).alias("_parts"))
    made = made.select("_row", F.array_join(F.transform("_parts", lambda x: x["part"]), "").alias(name))
    return rows.join(made, "_row", "left").drop("_row")


def read_sequences(wanted: DataFrame, reads: DataFrame) -> DataFrame:
    """The reads that wanted (read_id) names: an equi-join, whatever the number."""
    return reads.join(wanted.select("read_id").distinct(), "read_id", "left_semi")


def inserted_sequence(rows: DataFrame, reads: DataFrame) -> DataFrame:
    """rows (q_read, q_start, q_len, q_strand) with ins_seq: that stretch of the read, from its other end and complemented on reverse reads. Only reads that are asked for
    meet the rows."""
    wanted = rows.filter("q_read is not null").select(F.col("q_read").alias("read_id"))
    seqs = read_sequences(wanted, reads).select(F.col("read_id").alias("q_read"), F.col("seq").alias("_s"))
    a, n = F.col("q_start").cast("int"), F.col("q_len").cast("int")
    total = F.length("_s")
    back = reverse_complement(F.substring("_s", F.greatest(total - a - n, F.lit(0)) + 1, n))
    return rows.join(seqs, "q_read", "left").withColumn("ins_seq", F.when(F.col("q_strand") == "-", back).otherwise(F.substring("_s", a + 1, n))).drop("_s")


CONTIG_SCHEMA = CONTIGS
