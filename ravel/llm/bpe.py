"""Byte-level BPE with the tokenizers library, each distinct piece of text encoded once per worker.

The library splits a text into pieces before it merges bytes. Some of its borders are certain from the two or three characters around
them, and a text may be cut there: the ids of the pieces, one after another, are the ids of the text. Certain borders: between two of the kinds
letter, digit and sign (but not after an apostrophe, which may begin a contraction); before a newline that follows one of them; on both sides of a
newline that stands before one of them; before a single space between two of them. Kinds are known for ASCII and the Latin-1 letters; next to all other
characters no cut is made. Pieces of up to 32 bytes are looked up in the worker's cache by a 87-bit hash; new ones go through the library. Those
of one kind, with or without a space before them, are what the library's own splitting gives; they go to its model as they are, in the letters that stand for
bytes there, many in a string with spaces between them. The others go through all of the library. The cache is a table with open addressing that holds
`limit` pieces at most; a piece that finds no place is encoded each time.
The operators encode as the library does by itself: <|endoftext|> in a text is one id, 50256 (a slice of texts with that string is cut before
single spaces only). With `plain_specials` it is text like any other.
"""

from __future__ import annotations

import numpy as np

from ravel.llm import textcore as X

# Fixed kinds of bytes: 1 letters, 2 digits, 3 other visible signs, 4 space, 5 newline, 0 all else.
_KIND = np.array([4 if b == 0x20 else 5 if b == 0x0A else 0 if not 0x21 <= b <= 0x7E else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
_VISIBLE = np.array([False, True, True, True, False, False])
_SPECIAL = b"<|endoftext|>"
_LONGEST = 32
# The letters that stand for bytes in a byte-level vocabulary: visible Latin-1 characters for themselves, the other bytes in order from 256 on.
_SHOWN = np.array([0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b for b in range(256)])
_LETTER = np.where(_SHOWN, np.arange(256), 255 + np.cumsum(~_SHOWN)).astype("<u4")
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_PROBES = 8
_PLACE = (1 << 40) - 1
U = np.uint64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def kinds(d: np.ndarray) -> np.ndarray:
    """The kind of each byte; both bytes of a Latin-1 letter (U+00C0 to U+00FF without the signs U+00D7 and U+00F7) are letters."""
    out = _KIND[d]
    at = np.flatnonzero(d[:-1] == 0xC3)
    at = at[(d[at + 1] != 0x97) & (d[at + 1] != 0xB7)]
    out[at] = 1
    out[at + 1] = 1
    return out


def cuts(s: X.Slice, kind: np.ndarray, fine: bool) -> np.ndarray:
    """Where pieces begin: at each document and each certain border (without `fine`: single spaces alone)."""
    d, n = s.data, len(s.data)
    seen = _VISIBLE[kind]
    cut = np.zeros(n, bool)
    if n > 2:
        cut[1:-1] = (kind[1:-1] == 4) & seen[:-2] & seen[2:]
        inner = s.off[1:-1]  # the neighbours must be of the same document
        cut[inner[inner > 0] - 1] = False
        if fine:
            line = kind == 5
            cut[:-1] |= line[:-1] & seen[1:]
            cut[inner[inner > 0] - 1] = False
            cut[1:] |= seen[:-1] & seen[1:] & (kind[:-1] != kind[1:]) & ~((d[:-1] == 0x27) & (kind[1:] == 1))
            cut[1:] |= (seen[:-1] & line[1:]) | (line[:-1] & seen[1:])
        cut[inner[inner < n]] = False
    cut[s.off[:-1][s.off[:-1] < s.off[1:]]] = True
    return np.flatnonzero(cut)


class Encoder:
    """ids of whole texts; `limit` bounds the cached pieces."""

    def __init__(self, path: str, limit: int = 1_500_000, plain_specials: bool = True):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = plain_specials
        self.specials = not plain_specials
        #: The model behind another splitting: its input is in the letters that stand for bytes, with spaces between pieces.
        self.bare = Tokenizer(self.model.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        #: Bytes of each id: a letter of the vocabulary's alphabet stands for one byte.
        self.bytes_of = np.zeros(self.model.get_vocab_size(), np.int64)
        for token, i in self.model.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.limit, self.held = limit, 0
        self._table(1 << 12)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _table(self, size: int) -> None:
        #: value: 23 bits of a second hash, 32 of the ids' place, 8 of their number.
        self.key, self.value = np.zeros(size, U), np.zeros(size, np.int64)
        self.shift, self.last = U(64 - (size.bit_length() - 1)), size - 1

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Place and number of each piece's ids (place << 8 | number), -1 where it isn't cached."""
        slot = (key >> self.shift).astype(np.int64)
        there, value = self.key[slot], self.value[slot]
        hit = (there == key) & (value >> 40 == check)
        out = np.where(hit, value & _PLACE, -1)
        open_ = np.flatnonzero(~hit & (there != 0))
        for k in range(1, _PROBES):
            if not len(open_):
                break
            slot = ((key[open_] >> self.shift).astype(np.int64) + k) & self.last
            there, value = self.key[slot], self.value[slot]
            hit = (there == key[open_]) & (value >> 40 == check[open_])
            out[open_[hit]] = value[hit] & _PLACE
            open_ = open_[~hit & (there != 0)]
        return out

    def _put(self, key: np.ndarray, value: np.ndarray) -> None:
        for k in range(_PROBES):
            if not len(key):
                return
            slot = ((key >> self.shift).astype(np.int64) + k) & self.last
            free = np.flatnonzero(self.key[slot] == 0)
            self.key[slot[free]] = key[free]
            won = np.zeros(len(key), bool)
            won[free] = self.key[slot[free]] == key[free]  # keys are distinct, so of those that want a slot one has it
            self.value[slot[won]] = value[won]
            self.held += int(won.sum())
            key, value = key[~won], value[~won]

    def _grow(self, more: int) -> None:
        size = len(self.key)
        while size < 2 * (self.held + more):
            size *= 2
        if size > len(self.key):
            at = np.flatnonzero(self.key)
            old = self.key[at], self.value[at]
            self._table(size)
            self.held = 0
            self._put(*old)

    def _encode(self, model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, length = [], np.empty(len(texts), np.int64)
        for lo in range(0, len(texts), 256):  # the library's results take many times the memory of their ids
            made = [e.ids for e in model.encode_batch_fast(texts[lo : lo + 256], add_special_tokens=False)]
            length[lo : lo + len(made)] = [len(x) for x in made]
            parts += [np.array(x, np.uint32) for x in made]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), length

    def _pieces(self, d: np.ndarray, a: np.ndarray, z: np.ndarray, simple: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces d[a:z], one after another in some order, with the start and number of each one's ids. Simple ones are told apart by
        the byte lengths of their ids; if that doesn't come out even they go through all of the library like the others."""
        start, length = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
        at, flat = np.flatnonzero(simple), np.zeros(0, np.uint32)
        if len(at):
            size = z[at] - a[at]
            stop = np.cumsum(size + 1)
            joined = np.full(int(stop[-1]), 0x20, "<u4")
            joined[X.runs_gather(stop - size - 1, size)] = _LETTER[d[X.runs_gather(a[at], size)]]
            last = np.append(np.flatnonzero((stop[1:] - 1) // 16384 != (stop[:-1] - 1) // 16384), len(at) - 1)
            edge = np.concatenate([[0], stop[last]]).tolist()
            flat, _ = self._encode(self.bare, [joined[x:y].tobytes().decode("utf-32-le") for x, y in zip(edge, edge[1:])])
            stop, upto = np.cumsum(size), np.cumsum(self.bytes_of[flat])
            cut = np.searchsorted(upto, stop)
            if len(flat) and upto[-1] == stop[-1] and (upto[cut] == stop).all():
                start[at] = np.concatenate([[0], cut[:-1] + 1])
                length[at] = cut + 1 - start[at]
            else:
                simple, flat = np.zeros(len(a), bool), np.zeros(0, np.uint32)
        alone = np.flatnonzero(~simple)
        if len(alone):
            more, n = self._encode(self.model, [d[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(a[alone].tolist(), z[alone].tolist())])
            start[alone], length[alone] = len(flat) + np.cumsum(n) - n, n
            flat = np.concatenate([flat, more])
        return flat, start, length

    def slice(self, s: X.Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice (uint32), and where each document begins (one more at the end)."""
        d, n = s.data, len(s.data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(s.docs + 1, np.int64)
        special = self.specials and _SPECIAL in d.tobytes()
        kind = kinds(d)
        at = cuts(s, kind, not special)
        ends = np.append(at[1:], n)
        size = ends - at
        key, check = _hashes(d, at, size)
        value = self._find(key, check)
        start, length = value >> 8, value & 0xFF
        base = end = self.used
        miss = np.flatnonzero(value < 0)
        if len(miss):
            order = miss[np.argsort(key[miss])]
            k1, k2 = key[order], check[order]
            # one of each kind is encoded; those of over 32 bytes, or with the same 64 bits as another kind, each by itself
            new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) | (size[order] > _LONGEST)
            first = order[new]
            a, z = at[first], ends[first]
            change = np.concatenate([[0], np.cumsum(kind[1:] != kind[:-1], dtype=np.int32)])
            body = a + ((d[a] == 0x20) & (z - a > 1))
            simple = _VISIBLE[kind[body]] & (change[z - 1] == change[body]) & (z - a <= _LONGEST)
            flat, begin, count = self._pieces(d, a, z, simple)
            end = base + len(flat)
            if end > len(self.ids):
                grown = np.zeros(max(end, 2 * len(self.ids)), np.uint32)
                grown[: len(self.ids)] = self.ids
                self.ids = grown
            self.ids[base:end] = flat
            group = np.cumsum(new) - 1
            start[order], length[order] = base + begin[group], count[group]
            if self.held + len(first) <= self.limit and end < 1 << 32:
                keep = np.flatnonzero((z - a <= _LONGEST) & (key[first] != 0))
                keep = keep[np.concatenate([[True], key[first[keep[1:]]] != key[first[keep[:-1]]]])] if len(keep) else keep
                self._grow(len(keep))
                self._put(key[first[keep]], check[first[keep]] << 40 | (base + begin[keep]) << 8 | count[keep])
                self.used = end
        out = self.ids[X.runs_gather(start, length)]
        total = np.concatenate([[0], np.cumsum(length)])
        return out, total[np.searchsorted(at, s.off)]


def _hashes(d: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes (64 bits, 23 bits) of the pieces' bytes and lengths; pieces of over 32 bytes, which are never cached, have 0 as the first."""
    padded = np.zeros(len(d) + _LONGEST + 8, np.uint8)
    padded[: len(d)] = d
    eight = np.ndarray(len(d) + _LONGEST, "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        n = np.minimum(size, _LONGEST)
        h1 = size.astype(U) * U(0x9E3779B97F4A7C15)
        h2 = size.astype(U) * U(0xC2B2AE3D27D4EB4F) + U(1)
        which = None
        for k in range(0, _LONGEST, 8):
            if k:
                which = np.flatnonzero(n > k) if which is None else which[n[which] > k]
                if not len(which):
                    break
            a, m = (at, n) if which is None else (at[which] + k, n[which] - k)
            v = eight[a] & _MASKS[np.minimum(m, 8)]
            x = (v ^ (h1 if which is None else h1[which])) * U(0xFF51AFD7ED558CCD)
            x ^= x >> U(32)
            y = (v + (h2 if which is None else h2[which])) * U(0xC4CEB9FE1A85EC53)
            y ^= y >> U(29)
            if which is None:
                h1, h2 = x, y
            else:
                h1[which], h2[which] = x, y
        h1 = h1 * U(0xD6E8FEB86659FD93)
        h1 ^= h1 >> U(29)
    h1[size > _LONGEST] = 0
    return h1, (h2 >> U(41)).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, plain_specials=False)
    return _encoders[path]
