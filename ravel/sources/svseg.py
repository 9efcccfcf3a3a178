"""Skeleton files: a line ">read length", then a line of segments chr,strand,rd_l,rd_r,rf_l,rf_r,len joined by |."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_records(records: DataFrame) -> DataFrame:
    """Segments from records (value: the header without > , a line end, the segment line)."""
    parts = F.split("value", "\r?\n")
    head = F.split(F.trim(F.regexp_replace(parts[0], "^>", "")), "[ ,\\[\\]]+")
    rows = records.select(head[0].alias("read_id"), F.get(head, F.lit(1)).try_cast("bigint").alias("read_len"), F.posexplode(F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "[|<>]"), lambda x: F.trim(x) != "")).alias("seg_idx", "v"))
    f = F.filter(F.split(F.trim("v"), "[,\\[\\] ]+"), lambda x: x != "")
    out = rows.select("read_id", "read_len", F.col("seg_idx").cast("bigint").alias("seg_idx"), f.alias("f"))
    cols = [F.get("f", F.lit(i)).try_cast("bigint").alias(n) for i, n in enumerate(("rd_l", "rd_r", "rf_l", "rf_r", "seg_len"), 2)]
    return out.select("read_id", "read_len", "seg_idx", F.get("f", F.lit(0)).alias("chr"), F.get("f", F.lit(1)).alias("strand"), *cols)


def read_svseg(spark: SparkSession, path: str) -> DataFrame:
    return parse_records(spark.read.option("lineSep", "\n>").text(path))


def format_records(segments: DataFrame) -> DataFrame:
    """One row (read_id, value) a read: header and segment line, segments by seg_idx. Reads without segments have no rows and so no record."""
    text = F.concat_ws(",", "chr", "strand", *(F.col(c).cast("string") for c in ("rd_l", "rd_r", "rf_l", "rf_r", "seg_len")))
    g = segments.groupBy("read_id", "read_len").agg(F.array_sort(F.collect_list(F.struct("seg_idx", text.alias("t")))).alias("s"))
    line = F.array_join(F.transform("s", lambda x: x["t"]), "|")
    return g.select("read_id", F.concat(F.lit(">"), F.col("read_id"), F.coalesce(F.concat(F.lit(" "), F.col("read_len").cast("string")), F.lit("")), F.lit("\n"), line).alias("value"))


def write_svseg(segments: DataFrame, path: str) -> None:
    format_records(segments).select("value").write.text(path)
