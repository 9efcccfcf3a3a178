"""Connected components of links between documents.

Links are contracted where they lie: a task joins what its own links connect and passes on a star of each part. Below `most` links one task sees them all, and
that is the result. Above it, rounds of large and small stars over written tables bring every node nearer to the least node it knows until
nothing changes; the number of rounds is logarithmic in the longest path, and each begins with a contraction in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.llm.common import cut

#: Links that one task may hold at once (some 200 bytes each).
MOST = 1 << 20


def _contract(most: int):
    """A function over batches of links (u, v): of each `most` of them, every node with the least node of its part."""

    def stars(parent: dict[str, str]) -> pa.RecordBatch:
        nodes = list(parent)
        roots = []
        for x in nodes:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            roots.append(x)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(roots, pa.string())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[str, str] = {}
        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                for x in (u, v):
                    parent.setdefault(x, x)
                while parent[u] != u:
                    parent[u] = parent[parent[u]]
                    u = parent[u]
                while parent[v] != v:
                    parent[v] = parent[parent[v]]
                    v = parent[v]
                if u != v:
                    parent[max(u, v)] = min(u, v)
            if len(parent) > most:
                yield stars(parent)
                parent.clear()
        if parent:
            yield stars(parent)

    return run


def components(links: DataFrame, most: int = MOST) -> DataFrame:
    """node, root: the least node of its component, for every node of links (u, v: strings)."""
    links = cut(links.select("u", "v"), "links")
    state = None
    while links.count() > most:
        # a link of a node with itself says nothing, but for a component that is down to its root
        both = links.mapInArrow(_contract(most), "u string, v string").filter("u <> v")
        both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large.union(low.filter("m < u").select("u", F.col("m").alias("v"))).distinct(), "large")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = cut(small.distinct(), "links")
        new = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == state:
            roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
        state = new
    return cut(links.coalesce(1).mapInArrow(_contract(1 << 62), "u string, v string").select(F.col("u").alias("node"), F.col("v").alias("root")), "components")
