"""Unipaths: the compacted de Bruijn graph of a reference, and what a seed may look up in it.

Nodes are the distinct k-mers, and there is an edge where one follows another at the next position of a contig. A link u -> v joins two nodes if every occurrence
of u is followed by v and every one of v preceded by u (the ends of contigs and letters other than ACGT count as neighbours of their own). A unipath is a
maximal run of such links; its k-mers have equally many copies.

The occurrences of v are then those of u moved by one, so their first ones are next to each other too: along the first occurrences a unipath is an island of
neighbouring positions. So no pointers are followed: each k-mer learns its only neighbours from minima and maxima over its occurrences, one join tells whether the
link holds on both sides, and a count of path heads along each contig, by ranges, numbers the paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravel.operators.extension import tiles
from ravel.operators.ranks import ranks


def kmer_links(reference: DataFrame, k: int, clean: bool = True, core: int = 1024) -> DataFrame:
    """chr, pos (from 1), kmer, prev, next of every position of reference (chr, seq, perhaps at); prev and next are null where there is none. With clean, k-mers
    with letters other than ACGT are no k-mers."""
    t = tiles(reference, core, k + 1)
    # the tile's own places, from 1 within its text
    first = (F.col("tile") * core - F.col("at") + 1).cast("int")
    last = F.least(first + core - 1, F.length("seq") - k + 1)
    at = F.when(last >= first, F.sequence(first, last))

    def piece(i):
        cut = lambda j: F.substring("seq", j, F.lit(k))
        after = cut(i + 1)
        return F.struct((F.col("at") + i).cast("bigint").alias("pos"), cut(i).alias("kmer"), F.when(i > 1, cut(i - 1)).alias("prev"), F.when(F.length(after) == k, after).alias("next"))

    rows = t.select("chr", F.explode(F.transform(at, piece)).alias("x")).select("chr", "x.*")
    if clean:
        good = lambda c: F.when(F.col(c).rlike("^[ACGT]+$"), F.col(c)).alias(c)
        rows = rows.select("chr", "pos", *(good(c) for c in ("kmer", "prev", "next"))).filter("kmer is not null")
    return rows


def unipath_kmers(reference: DataFrame, k: int, clean: bool = True) -> DataFrame:
    """kmer, copies, chr and pos of its first occurrence, unipath (a number within that chr, from 1) and offset (from 0) of every distinct k-mer."""
    none = F.lit("")
    sides = [f(F.coalesce(F.col(c), none)).alias(f"{c}_{n}") for c in ("prev", "next") for f, n in ((F.min, "a"), (F.max, "b"))]
    nodes = kmer_links(reference, k, clean).groupBy("kmer").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("chr", "pos")).alias("first"), *sides)
    only = lambda c: F.when((F.col(f"{c}_a") == F.col(f"{c}_b")) & (F.col(f"{c}_a") != none), F.col(f"{c}_a"))
    nodes = nodes.select("kmer", "copies", "first.chr", "first.pos", only("prev").alias("prev"), only("next").alias("next"))
    follows = nodes.filter("next is not null").select(F.col("kmer").alias("prev"), F.col("next").alias("kmer"), F.lit(False).alias("head"))
    nodes = nodes.join(follows, ["kmer", "prev"], "left").withColumn("head", F.coalesce("head", F.lit(True)))
    rows = ranks(nodes.select("kmer", "copies", "chr", "pos", "head"), ["chr"], ["pos"], "before", F.col("head"))
    rows = rows.withColumn("unipath", (F.col("before") + F.col("head").cast("int")).cast("bigint"))
    offset = F.col("pos") - F.min("pos").over(Window.partitionBy("chr", "unipath"))
    return rows.select("kmer", "copies", "chr", "pos", "unipath", offset.alias("offset"))


def unipaths(kmers: DataFrame) -> DataFrame:
    """chr, unipath, pos (of the first copy), kmers (how many), copies of each unipath of unipath_kmers."""
    return kmers.groupBy("chr", "unipath").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("kmers"), F.max("copies").alias("copies"))


def lookup_table(reference: DataFrame, k: int, seed_k: int, max_unipath: int, max_copies: int, clean: bool = True) -> DataFrame:
    """kmer (the first seed_k letters), chr, pos of all occurrences that a seed may find: seeds that begin more than max_unipath k-mers (each a place in a unipath) find
    nothing, nor do unipaths of more than max_copies copies."""
    rows = kmer_links(reference, k, clean).select("chr", "pos", "kmer")
    nodes = rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("copies")).withColumn("seed", F.substring("kmer", 1, seed_k))
    few = nodes.groupBy("seed").agg(F.count(F.lit(1)).alias("paths")).filter(F.col("paths") <= max_unipath)
    kept = nodes.filter(F.col("copies") <= max_copies).join(few, "seed").select("kmer", "seed")
    return rows.join(kept, "kmer").select(F.col("seed").alias("kmer"), "chr", "pos")
