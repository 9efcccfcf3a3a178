"""Position clusters of a stream of signatures, as session windows over the coordinate axis.

A coordinate becomes a time in seconds, so that Structured Streaming's session windows do what islands() does in a batch: a session ends
where the next position lies more than `bias` further on. For streams that come in the order of positions, as from a sorted file or a
coordinate-sorted queue; rows later than `late` behind the furthest position are dropped by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_stream(sigs: DataFrame, bias: int = 1000, late: int = 10_000, min_support: int = 10) -> DataFrame:
    """chr, first_pos, last_pos, n, reads of each cluster of a stream (or table) of sigs (chr, pos, read_id)."""
    rows = sigs.withColumn("at", F.timestamp_seconds("pos"))
    if sigs.isStreaming:
        rows = rows.withWatermark("at", f"{late} seconds")
    g = rows.groupBy("chr", F.session_window("at", f"{bias} seconds")).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct("read_id", 0.01).alias("reads"))
    return g.filter(F.col("n") >= min_support).drop("session_window")
