"""Gap-and-island numbering: the one mechanism behind every merge and cluster rule here.

A row starts a new island if `breaks` holds against its immediate predecessor in the order; the island number is a running sum of those
starts. One shuffle on the keys; windows over the same keys and order share it and its sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window(keys: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], breaks, name: str = "island") -> DataFrame:
    """df with `name`, 1 for the first island of its keys. breaks: a function of prev(expression), the value in the row before."""
    w = window(keys, order)

    def prev(x: str | Column) -> Column:
        return F.lag(x).over(w)

    start = F.when(F.coalesce(breaks(prev), F.lit(True)), 1).otherwise(0)
    flagged = df.withColumn(f"_{name}", start)
    return flagged.withColumn(name, F.sum(f"_{name}").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop(f"_{name}")


def gap_blocks(df: DataFrame, keys: Sequence[str], position: str, gap: int, name: str = "block") -> DataFrame:
    """df with `name`, a number that changes wherever consecutive positions of a key lie more than `gap` apart (and maybe nowhere else).

    Large keys (a chromosome that holds a third of all rows) can then be worked on as (key, block): a wider gap ends any island.
    Blocks come from the occupied coarse bins of width gap + 1, of which there are few; no window sees the rows themselves. Two positions
    more than 2 * (gap + 1) apart with no bin between them are in different blocks; closer ones stay together, which is safe."""
    bin_ = F.floor(F.col(position) / (gap + 1))
    bins = df.select(*keys, bin_.alias("_bin")).distinct()
    w = window(keys, ["_bin"])
    numbered = bins.withColumn("_s", F.when(F.col("_bin") - F.lag("_bin").over(w) > 1, 1).otherwise(0)).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s")
    side = numbered.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_bin", name)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [bin_.eqNullSafe(F.col("_bin"))]
    return df.join(side, on).drop(*(f"_k{i}" for i in range(len(keys))), "_bin")
