"""The seed walk: which seeds of a read are looked at depends on what the ones before them found.

A run of letters (a read's part between N) has a head, a middle and a tail. The walk begins at offset 20 and takes one stride after the other. A zone ends when it
has had as many seeds with anchors as its cap, or at its own end, and the next zone begins where the walk then is, not at a place of its own. A seed that lies
inside what is already covered is passed over: it is not looked up and does not count. An anchor's left end may not go back over what is covered.

On Spark: every place a walk could come to lies on a grid (20 and multiples of the strides' common divisor behind it), so the k-mers of the grid are joined with
the index once; a bit filter of the index, of fixed size, leaves most of them behind in the task that cuts them. Hits of one diagonal that overlap are one match; its reach tables (extension.py) answer how far an anchor goes under the limits that the
walk meets. The walk itself is then whole numbers over one read's rows, in an Arrow stream sorted by read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.operators.extension import asked, furthest, letters, reach_tables
from ravel.operators.islands import islands
from ravel.operators.streams import by_key
from ravel.plans.tables import materialise
from ravel.schema import AlignOptions

#: Fixed values of the walk: the first offset, the letters of head and tail, their stride and cap, and how long a run with head and tail is at least.
FIRST, ENDS, ENDS_STRIDE, ENDS_CAP, LONG = 20, 100, 10, 3, 300
#: The filter has 2 ** BITS bits, whatever the size of the index; above this share of set ones it isn't used.
BITS, FULL = 25, 0.5
#: Two bits a base by code point (others: -1), and letters that are looked at together.
_BASE = np.full(128, -1, np.int64)
_BASE[[65, 67, 71, 84]] = range(4)
_SLICE = 1 << 20


def zones(n: int, o: AlignOptions) -> list[tuple[int, int, int]]:
    """(end, stride, cap) of the zones of a run of n letters."""
    step = max(5, o.seed_step)
    if n < LONG:
        return [(n, step, n // o.seed_step)]
    return [(ENDS, ENDS_STRIDE, ENDS_CAP), (n - ENDS, step, (n - 2 * ENDS) // o.seed_step), (n, ENDS_STRIDE, ENDS_CAP)]


def read_runs(reads: DataFrame, k: int, clean: bool) -> DataFrame:
    """read_id (and strand, if there is one), run_at, run_len, run: the maximal runs without N of k letters or more; without clean the whole read."""
    keys = [c for c in ("read_id", "strand") if c in reads.columns]
    if not clean:
        return reads.select(*keys, F.lit(0).cast("bigint").alias("run_at"), F.length("seq").cast("bigint").alias("run_len"), F.col("seq").alias("run"))
    parts = F.split(F.upper("seq"), "(?<=N)(?=[^N])|(?<=[^N])(?=N)")
    rows = reads.select(*keys, F.posexplode(parts).alias("i", "run"), F.transform(parts, lambda x: F.length(x)).alias("n"))
    at = F.aggregate(F.slice("n", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + x)
    return rows.select(*keys, at.cast("bigint").alias("run_at"), F.length("run").cast("bigint").alias("run_len"), "run").filter((F.col("run_len") >= k) & ~F.col("run").startswith("N"))


def _slots(code: np.ndarray) -> np.ndarray:
    return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def _has(bits: np.ndarray, code: np.ndarray) -> np.ndarray:
    at = _slots(code)
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def index_bits(index: DataFrame) -> np.ndarray | None:
    """Which slots of the filter the k-mers (longs) of index have; None if they are too many for it to tell. What comes to the driver is bounded by the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, bool)
        for b in batches:
            bits[_slots(b.column(0).to_numpy(zero_copy_only=False))] = True
        words = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["word", "bits"])

    got = index.select("kmer").filter("kmer is not null").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << BITS - 6, np.int64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy()
    bits = words.view(np.uint8)
    return bits if np.unpackbits(bits).mean() <= FULL else None


def _cut_seeds(texts: list[str | None], k: int, every: int) -> tuple[np.ndarray, ...]:
    """Of the places that a walk could come to in the runs of texts: the text's number, run_at, run_len, pos (from 1 in the text), and the k-mer's code."""
    flat, at = letters(texts)
    base = np.where(flat < 128, _BASE[np.minimum(flat, 127)], -1)
    inside = flat != ord("N")
    full = np.flatnonzero(np.diff(at))
    opens, closes = np.ones(len(flat), bool), np.ones(len(flat), bool)
    opens[1:], closes[:-1] = ~inside[:-1], ~inside[1:]
    opens[at[full]], closes[at[full + 1] - 1] = True, True
    start, end = np.flatnonzero(inside & opens), np.flatnonzero(inside & closes) + 1
    # a seed must end before the last letter of its zone, so also of its run
    count = np.maximum(-((FIRST + k - (end - start)) // every), 0)
    run = np.repeat(np.arange(len(start)), count)
    place = start[run] + FIRST + every * (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count))
    code, good = np.zeros(len(run), np.int64), np.ones(len(run), bool)
    for i in range(k):
        b = base[place + i]
        good &= b >= 0
        code = code << 2 | b & 3
    run, place, code = run[good], place[good], code[good]
    text = np.searchsorted(at, place, "right") - 1
    return text, start[run] - at[text], (end - start)[run], place - at[text] + 1, code


def grid_seeds(reads: DataFrame, o: AlignOptions, clean: bool = True, bits: Broadcast | None = None) -> DataFrame:
    """The k-mers at every place that a walk could come to: the keys of read_runs, pos (from 1 in the read), kmer (with clean two bits a base, as a long). bits: with clean, the
    filter of the index, which k-mers that it has not are left out by."""
    every = math.gcd(ENDS_STRIDE, max(5, o.seed_step))
    if clean:
        keys, k = [c for c in ("read_id", "strand") if c in reads.columns], o.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column("seq").to_pylist()
                ends = np.cumsum([len(t or "") for t in texts])
                lo = 0
                while lo < len(texts):
                    hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _SLICE, "right")))
                    text, *cols = _cut_seeds(texts[lo:hi], k, every)
                    if bits is not None:
                        some = _has(bits.value, cols[-1])
                        text, cols = text[some], [c[some] for c in cols]
                    if len(text):
                        of = pa.array(text + lo)
                        yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in keys), *(pa.array(c.astype(np.int64)) for c in cols)], names=[*keys, "run_at", "run_len", "pos", "kmer"])
                    lo = hi

        return reads.select(*keys, F.upper("seq").alias("seq")).mapInArrow(run, "".join(f"{c} string, " for c in keys) + "run_at long, run_len long, pos long, kmer long")
    runs = read_runs(reads, o.k, clean)
    keys = [c for c in runs.columns if c != "run"]
    # k-mers are cut from short pieces, as the cost of a substring grows with its place in a text
    width = 1000 // every * every
    n = F.col("run_len") - FIRST
    pieces = F.when(n > o.k, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda i: F.substring(F.col("run"), i * width + FIRST + 1, F.lit(width + o.k))))
    rows = runs.select(*keys, F.posexplode(pieces).alias("j", "piece"))
    # a seed must end before the last letter of its zone, so also of its run
    count = F.floor((F.least(F.length("piece") - o.k, F.lit(width)) - 1) / every)
    made = F.when(count >= 0, F.transform(F.sequence(F.lit(0), count.cast("int")), lambda i: F.struct((F.col("run_at") + F.col("j") * width + FIRST + i * every + 1).cast("bigint").alias("pos"), F.substring(F.col("piece"), i * every + 1, F.lit(o.k)).alias("kmer"))))
    return rows.select(*keys, F.explode(made).alias("s")).select(*keys, "s.pos", "s.kmer")


def matches(seeds: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Hits of seeds in the index (kmer, chr, pos), those of one diagonal that overlap as one row: rd_l, rd_r, rf_l, rf_r from 1, and `places`, where its seeds begin on the read. A
    diagonal's places are some of one read's, so the list is bounded by it."""
    keys = [c for c in seeds.columns if c not in ("pos", "kmer")]
    hits = seeds.join(index.select("kmer", "chr", F.col("pos").alias("rf")), "kmer").withColumn("diag", F.col("rf") - F.col("pos"))
    rows = islands(hits, [*keys, "chr", "diag"], ["pos"], lambda prev: F.col("pos") - prev("pos") > k)
    out = rows.groupBy(*keys, "chr", "diag", "island").agg(F.min("pos").alias("rd_l"), (F.max("pos") + k - 1).alias("rd_r"), F.array_sort(F.collect_list("pos")).alias("places"))
    return out.withColumn("rf_l", F.col("rd_l") + F.col("diag")).withColumn("rf_r", F.col("rd_r") + F.col("diag")).drop("diag", "island")


class Match:
    """A match of one read, from 0, with its reach tables."""

    def __init__(self, chrom: str, a: int, z: int, diag: int, left: np.ndarray, right: np.ndarray, o: AlignOptions):
        self.chrom, self.a, self.z, self.diag, self.o = chrom, a, z, diag, o
        shape = (1, o.edit_dis + 1, 2 * o.edit_dis + 1)
        self.left, self.right = (np.asarray(t, np.int64).reshape(shape) for t in (left, right))

    def _reach(self, table: np.ndarray, read: int, ref: int) -> tuple[int, int, int]:
        if self.o.edit_dis == 0:
            n = max(0, min(int(table[0, 0, 0]), read, ref))
            return n, n, 0
        a, b, e = furthest(table, np.array([max(read, 0)]), np.array([max(ref, 0)]))
        return int(a[0]), int(b[0]), int(e[0])

    def anchor(self, j: int, lowest: int, run_end: int, genome: float) -> tuple[int, int, int, int, int, float] | None:
        """rd_l, rd_r, rf_l, rf_r (from 0, inclusive), edits and score of the seed at j, not going left of `lowest`; None if it is too short or scores too low."""
        o, k = self.o, self.o.k
        a, z = min(j, max(self.a, lowest, j - o.extend_mx)), min(self.z, j + k - 1 + o.extend_mx)
        # beyond the ends of the match itself, if the limits leave them
        x, u, e = self._reach(self.left, a - lowest, o.extend_mx - (j - a)) if a == self.a and lowest <= a else (0, 0, 0)
        y, v, f = self._reach(self.right, run_end - 1 - z, o.extend_mx - (z - j - k + 1)) if z == self.z else (0, 0, 0)
        # the exact part of both reaches counts as it is, the rest by its shorter side
        total = z - a + 1 + min(x, u) + min(y, v)
        edits = e + f
        score = anchor_log_odds(total - edits + abs(x - u) + abs(y - v), edits, genome, o)
        least = k + 2 * o.edit_dis + 7
        if total < least or score < least:
            return None
        return a - x, z + y, a + self.diag - u, z + self.diag + v, edits, score


def anchor_log_odds(equal: int, edits: int, genome: float, o: AlignOptions) -> float:
    hit = sum(o.errors())
    return equal * -10 * math.log10(0.25 / (1 - hit)) + edits * -10 * math.log10(0.75 / hit) - 10 * math.log10(genome)


def walk(run_at: int, run_len: int, at: dict[int, list[Match]], genome: float, o: AlignOptions, room: int) -> list[tuple]:
    """The anchors of a run, in the order of the walk: seed place, contig, and what Match.anchor gives. at: the matches at each place (from 0 in the read); room:
    how many anchors the read may still have."""
    out: list[tuple] = []
    place, covered = FIRST, 0
    for end, stride, cap in zones(run_len, o):
        found = 0
        while found < cap and place + o.k < end:
            j = place + run_at
            place += stride
            if j + o.k < covered:
                continue
            if len(out) >= room:
                return out
            lowest = covered + 1 if covered > 0 else 0
            reach = covered
            some = False
            for m in at.get(j, ()):
                got = m.anchor(j, lowest, run_at + run_len, genome)
                if got is not None:
                    some = True
                    out.append((j, m.chrom, *got))
                    reach = max(reach, got[1])
            covered = reach
            found += some
    return out


def seed_walk(reads: DataFrame, index: DataFrame, reference: DataFrame, genome: float, o: AlignOptions = AlignOptions(), clean: bool = True) -> DataFrame:
    """The anchors of reads (read_id, strand, seq) that the walk finds: read_id, strand, chr, seed, rd_l, rd_r, rf_l, rf_r (from 1), edits, score. index: kmer, chr, pos
    of what may be looked up; genome: the letters of the reference."""
    keys = ["read_id", "strand"]
    bits = None
    if clean:
        some = index_bits(index)
        bits = None if some is None else reads.sparkSession.sparkContext.broadcast(some)
    # written: the reads that have matches are picked by them, then cut around them
    found = materialise(matches(grid_seeds(reads, o, clean, bits), index, o.k), "matches")
    reads = asked(reads, found, keys)
    rows = reach_tables(found, reads, reference, keys, o.edit_dis, o.extend_mx, bases=clean)

    def work(g: dict[str, np.ndarray]) -> dict[str, list]:
        made: list[tuple] = []
        bounds = [0, *(np.flatnonzero(g["run_at"][1:] != g["run_at"][:-1]) + 1).tolist(), len(g["run_at"])]
        for lo, hi in zip(bounds, bounds[1:]):
            at: dict[int, list[Match]] = {}
            for i in range(lo, hi):
                m = Match(g["chr"][i], int(g["rd_l"][i]) - 1, int(g["rd_r"][i]) - 1, int(g["rf_l"][i] - g["rd_l"][i]), g["left"][i], g["right"][i], o)
                for p in g["places"][i].tolist():
                    at.setdefault(p - 1, []).append(m)
            made += walk(int(g["run_at"][lo]), int(g["run_len"][lo]), at, genome, o, o.max_seeds - len(made))
        n = len(made)
        cols = list(zip(*made)) if made else [()] * 8
        seed, chrom, a, z, x, y, edits, score = (list(c) for c in cols)
        up = lambda v: [i + 1 for i in v]
        return {"read_id": [g["read_id"][0]] * n, "strand": [g["strand"][0]] * n, "chr": chrom, "seed": up(seed), "rd_l": up(a), "rd_r": up(z), "rf_l": up(x), "rf_r": up(y), "edits": edits, "score": score}

    schema = "read_id string, strand string, chr string, seed bigint, rd_l bigint, rd_r bigint, rf_l bigint, rf_r bigint, edits bigint, score double"
    return by_key(rows.select(*keys, "run_at", "run_len", "chr", "rd_l", "rd_r", "rf_l", "places", "left", "right"), keys, ["run_at", "rd_l", "rd_r", "chr", "rf_l"], work, schema)
