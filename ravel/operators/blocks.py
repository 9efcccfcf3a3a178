"""Block extension: how far a noisy match goes on, by short k-mers of the reference.

The read is cut into blocks of `block` letters from where the match ends. The reference leads: place by place behind the last block's begin, its k-mer is looked for in the
read's present block, at most half a block of drift away (with the noisy error model: as far as its rates allow). The first place with one ends the search in that
block, the least drift wins, and the next block of the reference begins where the hit says; after a drift of three letters or more it begins at a running
fractional place instead, which moves by a block and the expected surplus of deletions. A block without a hit within its length is the end.

All segments of an Arrow batch take a step, a block each, at once; what is compared is a table of `block` + 1 by `block` k-mer codes for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ravel.operators.extension import letters, tiles, windows_around
from ravel.schema import AlignOptions

_BASE = np.full(128, -1, np.int64)
_BASE[[65, 67, 71, 84]] = range(4)


def kmer_codes(flat: np.ndarray, k: int, bad: int) -> np.ndarray:
    """Two bits a base for the k letters from each place on; `bad` where one of them is no base."""
    n = max(len(flat) - k + 1, 0)
    base = np.where(flat < 128, _BASE[np.minimum(flat, 127)], -1)
    code, wrong = np.zeros(n, np.int64), np.zeros(n, bool)
    for i in range(k):
        code = code << 2 | np.maximum(base[i : i + n], 0)
        wrong |= base[i : i + n] < 0
    return np.where(wrong, bad, code)


def block_reach(read: list[str], ref: list[str], o: AlignOptions, last_of_equals: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Letters of read and reference that each match goes on from the start of both texts. Of hits with equal drift the last on the read counts, or the first."""
    k, size = o.hash_k, o.block
    ins, dele, _ = o.errors()
    surplus = dele - ins
    most = size // 2 if o.error_model == 1 else abs(2 * size * surplus * 2 * 3)
    p, po = letters(read)
    q, qo = letters(ref)
    pn, qn = np.diff(po), np.diff(qo)
    pc, qc = kmer_codes(p, k, -1), kmer_codes(q, k, -2)
    n = len(pn)
    begin, place = np.zeros(n, np.int64), np.zeros(n)
    far = np.zeros((n, 2), np.int64)
    live = np.flatnonzero(np.minimum(pn, qn) > size)
    x, i = np.arange(size), np.arange(size + 1)
    drift = np.abs(x[None, :] - i[:, None])
    # the order in which hits of one place are preferred
    rank = drift * size + (size - 1 - x if last_of_equals else x)[None, :]
    turn = 0
    while len(live):
        at_p, at_q = turn * size + x[None, :], begin[live, None] + i[None, :]
        rd = np.where(at_p <= (pn[live] - k)[:, None], pc[np.minimum(po[live, None] + at_p, len(pc) - 1)], -1)
        rf = np.where(at_q <= (qn[live] - k)[:, None], qc[np.minimum(qo[live, None] + at_q, len(qc) - 1)], -2)
        same = (rf[:, :, None] == rd[:, None, :]) & (drift <= most)[None]
        places = same.any(2)
        some = places.any(1)
        live, same, first = live[some], same[some], places[some].argmax(1)
        if not len(live):
            break
        best = np.where(same[np.arange(len(live)), first], rank[first], size * size * 2).argmin(1)
        hit_q, off = begin[live] + first, drift[first, best]
        far[live, 0], far[live, 1] = turn * size + best + k - 1, hit_q + k - 1
        exact = hit_q - best + size
        place[live] = np.where((off < 3) | (o.error_model != 1), exact, place[live] + size + 2 * size * surplus)
        begin[live] = place[live].astype(np.int64)
        turn += 1
    return far[:, 0], far[:, 1]


def extend_blocks(rows: DataFrame, reads: DataFrame, reference: DataFrame, o: AlignOptions = AlignOptions()) -> DataFrame:
    """Segments (read_id, strand, chain, chr, ...) grown at both ends by block_reach, at most extend_mx letters each way. Only the letters around the ends go to Python."""
    keys = ["read_id", "strand"]
    cols = [*keys, "chain", "chr", "rd_l", "rd_r", "rf_l", "rf_r"]
    t = windows_around(rows.select(*cols), reads, tiles(reference, 8192, o.extend_mx), keys, o.extend_mx, 8192)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                text = {c: [s or "" for s in part.column(c).to_pylist()] for c in ("p_l", "p_r", "q_l", "q_r")}
                a, c = block_reach([s[::-1] for s in text["p_l"]], [s[::-1] for s in text["q_l"]], o, last_of_equals=False)
                z, d = block_reach(text["p_r"], text["q_r"], o)
                v = {x: part.column(x).to_numpy() for x in cols[4:]}
                moved = [v["rd_l"] - a, v["rd_r"] + z, v["rf_l"] - c, v["rf_r"] + d]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in cols[:4]), *map(pa.array, moved)], names=cols)

    return t.mapInArrow(run, "read_id string, strand string, chain bigint, chr string, rd_l bigint, rd_r bigint, rf_l bigint, rf_r bigint")
