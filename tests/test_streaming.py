"""Streamed clusters equal the batch ones."""

from pyspark.sql import functions as F

from ravel.operators.islands import islands
from ravel.streaming.clusters import cluster_stream


def test_stream_equals_batch(spark, tmp_path):
    rows = [("c", p, f"r{i}") for i, p in enumerate([1, 5, 1005, 2006, 9000, 9500, 9500, 30_000])] + [("d", 7, "x")]
    df = spark.createDataFrame(rows, "chr string, pos long, read_id string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = islands(df, ["chr"], ["pos"], lambda prev: F.col("pos") - prev("pos") > 1000).groupBy("chr", "island").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count(F.lit(1)).alias("n"))
    want = {(r.chr, r.a, r.b, r.n) for r in batch.collect()}
    assert {(r.chr, r.first_pos, r.last_pos, r.n) for r in cluster_stream(df, min_support=1).collect()} == want
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = cluster_stream(stream, min_support=1).writeStream.outputMode("complete").format("memory").queryName("clusters").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.chr, r.first_pos, r.last_pos, r.n) for r in spark.table("clusters").collect()} == want
