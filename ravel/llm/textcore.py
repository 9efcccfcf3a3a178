"""Vectorised text primitives shared by the corpus operators.

Arrow string batches are looked at as one byte buffer plus offsets, and cut into slices of a few MB of
whole documents, so that numpy works on many documents at once while memory stays bounded (a document that is longer
than a slice makes a slice of its own). Hashes are 64-bit polynomials over bytes with odd multipliers, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
U = np.uint64
_P1, _P2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_pow: dict[tuple[int, bool], np.ndarray] = {}


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, or of its inverse; kept for the next call."""
    key = (int(base), inverse)
    got = _pow.get(key)
    if got is None or len(got) < n:
        b = U(_inverse(int(base))) if inverse else base
        size = max(n, SLICE_BYTES + 4096)
        out = np.full(size, b, U)
        out[0] = 1
        with np.errstate(over="ignore"):
            got = np.multiply.accumulate(out)
        if size > 4 * SLICE_BYTES:  # do not hold the table of one giant document
            return got
        _pow[key] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """Like numpy.unique, by sorting."""
    if len(x) < 2:
        return x.copy()
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def sorted_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(x):
        return x, np.zeros(0, np.int64)
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[at], np.diff(np.append(at, len(x)))


class Slice:
    """Whole documents lo..hi of a batch: `data` bytes and `off`, where each document begins (one more at the end)."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, off: np.ndarray):
        self.lo, self.hi, self.data, self.off = lo, hi, data, off
        self.docs = hi - lo
        self._sums: dict[int, np.ndarray] = {}

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each document."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]

    def prefix(self, data: np.ndarray, base: np.uint64 = _P1) -> np.ndarray:
        with np.errstate(over="ignore"):
            terms = (data.astype(U) + U(1)) * powers(base, len(data))[: len(data)]
            return np.concatenate([np.zeros(1, U), np.cumsum(terms, dtype=U)])

    def spans_hash(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _P1) -> np.ndarray:
        """Hashes of the byte ranges [start, end)."""
        inv = powers(base, len(prefix), True)
        with np.errstate(over="ignore"):
            return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes with `inside` true, broken at documents: starts, ends and the number of runs before each document (one more at the end)."""
        n = len(inside)
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = True, True
            np.logical_not(inside[:-1], out=before[1:])
            np.logical_not(inside[1:], out=after[:-1])
            edge = self.off[(self.off > 0) & (self.off < n)]
            before[edge] = True
            after[edge - 1] = True
        starts = np.flatnonzero(inside & before)
        ends = np.flatnonzero(inside & after) + 1
        return starts, ends, np.searchsorted(starts, self.off)


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a column of strings into slices; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, body = texts.buffers()
    off = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def table(pred) -> np.ndarray:
    """A lookup table over the 256 byte values."""
    return np.array([bool(pred(b)) for b in range(256)])


#: Bytes of the words [^\x20\x09-\x0D]+ (UTF-8 bytes beyond ASCII are all inside).
NOT_SPACE = table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
ALNUM = table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: A-Z to a-z, all else as it is.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
#: First bytes of code points.
LEADS = table(lambda b: b & 0xC0 != 0x80)


def windows_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values of h; len(h) - n + 1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.zeros(m, U)
    mult = int(_P2)
    with np.errstate(over="ignore"):
        for k in range(n):
            out += h[k : k + m] * U(pow(mult, k + 1, 1 << 64))
    return mix(out)


def runs_gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... of each run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    out = np.ones(total, np.int64)
    at = np.cumsum(lengths) - lengths
    out[0] = starts[0]
    out[at[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)
