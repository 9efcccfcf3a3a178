"""Growing matches beyond their ends with a bounded number of edits, for all anchors of a batch at once.

For each number of edits e and each diagonal d (letters the reference is ahead of the read) the furthest reach is kept: how many letters of the read can be
matched, with e edits at most, so that the reference has given d more. A reach with e edits follows from those with e - 1 on the same diagonal (another
letter), the one below (a letter of the reference alone) and the one above (a letter of the read alone), and then slides over equal letters. With no
edits it is the longest common extension. Reaches are arrays over anchors, slides compare blocks of letters, so no anchor is a loop in Python.

Along a diagonal the distance never falls, so a reach under tighter limits is the smaller of the reach and the limit: the table of an anchor answers any later
limit without the sequences (see `furthest`), which the seed walk needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravel.plans.tables import materialise

#: Codes of letters other than ACGT on read and reference: such letters equal nothing.
NO_BASE = (0xFFFFFFFF, 0xFFFFFFFE)


def letters(texts: list[str | None], side: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another and where each begins (one more at the end). With side (0 read, 1 reference) letters other than ACGT get a
    code that the other side has not."""
    texts = [t or "" for t in texts]
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if side is not None:
        flat = np.where(np.isin(flat, [65, 67, 71, 84]), flat, np.uint32(NO_BASE[side]))
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def slide(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """How many letters are equal from p[i] and q[j] on (step 1) or back (step -1), n at most."""
    out = np.zeros(len(i), np.int64)
    live = np.flatnonzero(n > 0)
    width = 16
    while len(live):
        k = np.arange(width)
        room = (n - out)[live, None]
        at = out[live, None] + np.minimum(k, room - 1)
        same = (p[i[live, None] + step * at] == q[j[live, None] + step * at]) & (k < room)
        run = np.where(same.all(1), width, same.argmin(1))
        out[live] += run
        live = live[(run == width) & (out[live] < n[live])]
        width = min(1024, width * 4)
    return out


def reaches(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray, pn: np.ndarray, qn: np.ndarray, step: int, edits: int) -> np.ndarray:
    """Reach by anchor, edits and diagonal (column d + edits); -1 where there is none. i, j: the first letters; pn, qn: how many there are."""
    table = np.full((len(i), edits + 1, 2 * edits + 1), -1, np.int64)
    for e in range(edits + 1):
        for d in range(-e, e + 1):
            c = d + edits
            if e:
                before = table[:, e - 1]
                a = np.where(before[:, c] >= 0, before[:, c] + 1, -1)
                if d > -e:
                    a = np.maximum(a, before[:, c - 1])
                if d < e:
                    a = np.maximum(a, np.where(before[:, c + 1] >= 0, before[:, c + 1] + 1, -1))
            else:
                a = np.zeros(len(i), np.int64)
            a = np.minimum(np.minimum(a, pn), qn - d)
            ok = np.flatnonzero((a >= 0) & (a + d >= 0))
            a = a[ok]
            a = a + slide(p, q, i[ok] + step * a, j[ok] + step * (a + d), np.minimum(pn[ok] - a, qn[ok] - a - d), step)
            table[ok, e, c] = a
    return table


def furthest(table: np.ndarray, pn: np.ndarray, qn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the read, letters of the reference and edits of the furthest reach within the limits: the longest on the read, of equals that with the fewest
    edits, of those the longest on the reference."""
    n, rows, columns = table.shape
    d = np.arange(columns) - columns // 2
    a = np.minimum(np.minimum(table, pn[:, None, None]), qn[:, None, None] - d)
    ok = (table >= 0) & (a >= 0) & (a + d >= 0)
    e = np.arange(rows)[None, :, None]
    rank = np.where(ok, (a * rows + (rows - 1 - e)) * columns + d + columns // 2, -1).reshape(n, -1)
    best = rank.argmax(1)
    got = a.reshape(n, -1)[np.arange(n), best]
    return got, got + d[best % columns], best // columns


def tiles(reference: DataFrame, core: int, margin: int) -> DataFrame:
    """chr, tile, at, seq: overlapping pieces of reference (chr, seq, and the offset `at` of seq where it is itself a piece). Each piece gives its part to every
    tile it touches, and a tile puts its parts together, so no row is longer than a tile or a piece."""
    at = F.col("at").cast("bigint") if "at" in reference.columns else F.lit(0).cast("bigint")
    n = F.length("seq")
    rows = reference.select("chr", at.alias("from"), n.alias("n"), "seq").filter("n > 0")
    first, last = F.greatest(F.floor((F.col("from") - margin) / core), F.lit(0)), F.floor((F.col("from") + F.col("n") - 1 + margin) / core)
    rows = rows.withColumn("tile", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    lo, hi = F.greatest(F.col("tile") * core - margin, F.col("from")), F.least((F.col("tile") + 1) * core + margin, F.col("from") + F.col("n"))
    parts = rows.filter(hi > lo).select("chr", "tile", lo.alias("lo"), F.substring("seq", (lo - F.col("from") + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    out = parts.groupBy("chr", "tile").agg(F.min("lo").alias("at"), F.array_sort(F.collect_list(F.struct("lo", "part"))).alias("parts"))
    out = out.select("chr", "tile", "at", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("seq"))
    # a tile with margins alone has no core of its own
    return out.filter(F.col("at") + F.length("seq") > F.col("tile") * core)


def asked(reads: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """reads without those that rows have not, so that the letters of the others are neither turned nor shuffled."""
    return reads.join(rows.select(*keys).distinct(), keys, "left_semi")


def windows_around(anchors: DataFrame, reads: DataFrame, pieces: DataFrame, keys: list[str], width: int, core: int) -> DataFrame:
    """anchors with the letters around them: p_l, p_r of the read, q_l, q_r of the reference, `width` at most, and whether a read has more (more_l, more_r). Sequences
    are cut in the join, so nothing longer goes on."""
    a, z = F.col("rd_l"), F.col("rd_r")
    text = lambda c, lo, hi: F.substring(c, lo.cast("int"), F.greatest(hi - lo + 1, F.lit(0)).cast("int"))
    rows = anchors.join(reads.select(*keys, F.col("seq").alias("_seq")), keys)
    one = F.lit(1).cast("bigint")
    rows = rows.withColumn("p_l", text("_seq", F.greatest(one, a - width), a - 1)).withColumn("p_r", text("_seq", z + 1, z + width)).withColumn("more_l", a - 1 > width).withColumn("more_r", F.length("_seq") - z > width).drop("_seq")
    for side, pos in (("l", F.col("rf_l")), ("r", F.col("rf_r"))):
        t = pieces.select("chr", F.col("tile").alias("_t"), F.col("at").alias("_at"), F.col("seq").alias("_ref"))
        rows = rows.withColumn("_t", F.floor((pos - 1) / core).cast("int")).join(t, ["chr", "_t"])
        p = pos - F.col("_at")
        rows = rows.withColumn(f"q_{side}", text("_ref", F.greatest(one, p - width), p - 1) if side == "l" else text("_ref", p + 1, p + width)).drop("_t", "_at", "_ref")
    return rows


def _tables(rows: DataFrame, edits: int, bases: bool, width: int, kept: list[str]) -> DataFrame:
    """rows with left and right (reach tables as flat arrays) and `open`: whether a window was too short to tell."""
    schema = rows.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(lambda x: x.num_rows, batches):
            flats, is_open = [], np.zeros(b.num_rows, bool)
            for side, step in (("l", -1), ("r", 1)):
                p, po = letters(b.column(f"p_{side}").to_pylist(), 0 if bases else None)
                q, qo = letters(b.column(f"q_{side}").to_pylist(), 1 if bases else None)
                pn, qn = np.diff(po), np.diff(qo)
                t = reaches(p, q, po[1:] - 1 if step < 0 else po[:-1], qo[1:] - 1 if step < 0 else qo[:-1], pn, qn, step, edits)
                d = np.arange(2 * edits + 1) - edits
                more = np.asarray(b.column(f"more_{side}").to_numpy(zero_copy_only=False), bool)
                # a reach that ends at a window's end could go on if there is more behind it
                full = (((t >= pn[:, None, None]) & more[:, None, None]) | ((t + d >= qn[:, None, None]) & (qn >= width)[:, None, None])) & (t >= 0)
                is_open |= full.any((1, 2))
                flat = t.reshape(len(t), -1)
                flats.append(pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel().astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *flats, pa.array(is_open)], names=[*kept, "left", "right", "open"])

    out = schema.add("left", T.ArrayType(T.IntegerType())).add("right", T.ArrayType(T.IntegerType())).add("open", "boolean")
    return rows.mapInArrow(run, out)


def reach_tables(anchors: DataFrame, reads: DataFrame, reference: DataFrame, keys: list[str], edits: int, most: int, bases: bool = True, width: int = 128, core: int = 1024) -> DataFrame:
    """anchors (keys, chr, rd_l, rd_r, rf_l, rf_r from 1, other columns) with left and right, the reach tables beyond their ends, `most` letters at most. Short windows are tried
    first; the few anchors that reach their ends get windows of `most` letters."""
    kept = anchors.columns
    short = min(width, most)
    first = _tables(windows_around(anchors, reads, tiles(reference, core, short), keys, short, core), edits, bases, short, kept)
    if short == most:
        return first.drop("open")
    first = materialise(first, "reaches")
    # tiles of the wide pass only where they are asked for
    again = first.filter("open").select(*kept)
    wide = _tables(windows_around(again, reads, tiles(reference, 8 * core, most), keys, most, 8 * core), edits, bases, most, kept)
    return first.filter(~F.col("open")).unionByName(wide).drop("open")


def bounded_extension(anchors: DataFrame, reads: DataFrame, reference: DataFrame, keys: list[str], edits: int, most: int = 5000, bases: bool = True) -> DataFrame:
    """anchors grown on both sides by `edits` edits and `most` letters a side at most; edits: what both sides took."""
    kept = [*keys, "chr", "rd_l", "rd_r", "rf_l", "rf_r"]
    rows = reach_tables(anchors.select(*kept), reads, reference, keys, edits, most, bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(lambda x: x.num_rows, batches):
            cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("rd_l", "rd_r", "rf_l", "rf_r")}
            no_limit = np.full(b.num_rows, np.iinfo(np.int64).max >> 8)
            a, x, e = furthest(unpack(b.column("left"), edits), no_limit, no_limit)
            z, y, f = furthest(unpack(b.column("right"), edits), no_limit, no_limit)
            new = {"rd_l": cols["rd_l"] - a, "rd_r": cols["rd_r"] + z, "rf_l": cols["rf_l"] - x, "rf_r": cols["rf_r"] + y}
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*keys, "chr"]), *(pa.array(v) for v in new.values()), pa.array((e + f).astype(np.int64))], names=[*kept, "edits"])

    return rows.mapInArrow(run, rows.select(*kept).schema.add("edits", T.LongType()))


def unpack(column: pa.Array, edits: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), edits + 1, 2 * edits + 1)
