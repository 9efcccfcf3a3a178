"""Range joins as binned equi-joins.

Spark plans a pure inequality join as a nested loop within the equi key. Here one side's windows are exploded over the coarse bins they
touch and the other side's over theirs; a pair that meets in several bins is kept in the first common one only, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _binned(df: DataFrame, lo: Column, hi: Column, width: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))


def containing(spans: DataFrame, windows: DataFrame, key: str, width: int = 10_000, span: tuple[str, str] = ("start", "end"), win: tuple[str, str] = ("win_start", "win_end")) -> DataFrame:
    """Pairs with span.start < win.start and span.end > win.end: a containing span covers the window's first bin, so windows aren't exploded."""
    w = windows.withColumn("_bin", F.floor(F.col(win[0]) / width))
    s = _binned(spans, F.col(span[0]), F.col(span[1]), width, "_bin")
    return w.join(s, [key, "_bin"]).filter((F.col(span[0]) < F.col(win[0])) & (F.col(span[1]) > F.col(win[1]))).drop("_bin")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: int, a_range: tuple[str, str], b_range: tuple[str, str]) -> DataFrame:
    """Pairs with max(a.lo, b.lo) <= min(a.hi, b.hi), each once."""
    x = _binned(a, F.col(a_range[0]), F.col(a_range[1]), width, "_bin")
    y = _binned(b, F.col(b_range[0]), F.col(b_range[1]), width, "_bin")
    lo = F.greatest(F.col(a_range[0]), F.col(b_range[0]))
    return x.join(y, [*keys, "_bin"]).filter((lo <= F.least(F.col(a_range[1]), F.col(b_range[1]))) & (F.floor(lo / width) == F.col("_bin"))).drop("_bin")


def band(a: DataFrame, b: DataFrame, keys: list[str], a_pos: str, b_pos: str, width: int) -> DataFrame:
    """Pairs with abs(a_pos - b_pos) <= width: each row of b looks into three bins."""
    size = max(1, width)
    x = a.withColumn("_bin", F.floor(F.col(a_pos) / size))
    at = F.floor(F.col(b_pos) / size)
    y = b.withColumn("_bin", F.explode(F.array(at - 1, at, at + 1)))
    return x.join(y, [*keys, "_bin"]).filter(F.abs(F.col(a_pos) - F.col(b_pos)) <= width).drop("_bin")
