"""Global positions without a window over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravel.plans.tables import materialise


def ranks(df: DataFrame, keys: list[str], order: list[str | Column], name: str, counted: Column | None = None) -> DataFrame:
    """df with `name`: how many rows of the same keys come before it in the order (only those for which `counted` holds). Rows are dealt by ranges of keys and order and written;
    each range counts its own rows, and a range's offset is the sum of those before it, so the largest key is as many tasks as it has ranges."""
    parts = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    parts = materialise(parts, "ranges")
    one = F.lit(1) if counted is None else counted.cast("int")
    whole = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy(*keys, "_range").agg(F.sum(one).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(whole), F.lit(0))).drop("_n")
    own = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("_own", F.coalesce(F.sum(one).over(own), F.lit(0)))
    return rows.join(before, [*keys, "_range"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")
