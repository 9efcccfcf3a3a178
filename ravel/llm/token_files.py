"""Token-ID output: Re-Pair grammar compression per shard, with rules, expansion lengths and random access.

Documents are dealt by ranges of (doc_id, hash of the text), sorted, encoded with the tokenizers library (the end id after each), and
cut into shards of whole documents of about `shard_ids` ids. In a shard frequent pairs of neighbouring symbols are replaced by nonterminals,
again and again until no pair is found twice or symbols run out (16 bits). Each round counts all pairs exactly and takes the most
frequent ones, few at first and more as the grammar grows; where occurrences of two of them overlap, the more frequent pair goes first. A pair that is left
with fewer than two occurrences is no rule. No pair reaches over a document's end, so a document is a range of symbols.

File format (a shard; little endian): b"RPG1", then eight uint32: documents, ids, symbols, rules, first nonterminal, flags (1: some
doc_ids are null), 0, crc32 of what follows; then int64 doc_id and uint8 null mark per document, uint32 ids per document and uint32 symbols per document, two uint32 per
rule (left, right), uint32 expansion length per rule, uint16 symbols. Shards are rows of a Parquet table (part, seq, docs, ids, first_id, last_id,
null_ids, shard) that Spark commits, so that any store Spark writes to will do and a lost executor leaves no half file. `fetch` reads the shards
whose range of doc_ids has the one that is asked for.

Defined cases: null text is empty; an empty text is the end id alone; equal doc_ids follow each other by the hash of their text; null doc_ids come
first; a text longer than a shard makes a shard of its own, its bytes and ids are in one task's memory; other columns are not read, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravel.llm import textcore as X
from ravel.llm.bpe import default_path, encoder
from ravel.llm.common import cut, parts_by_size, text_and_id


@dataclass(frozen=True)
class FileOptions:
    end: int = 2
    shard_ids: int = 1 << 20
    #: A round adds so many rules at most, and this share of the rules that are there.
    rules_per_round: int = 256
    growth: float = 0.75
    #: Pairs that a round looks at, in multiples of the rules that it may add.
    tried: float = 1.3


#: No symbol is 65535, so this is no pair.
_NO_PAIR = np.uint32(0xFFFFFFFF)
_SPREAD, _SLOTS = np.uint32(0x9E3779B1), 18


def repair(ids: np.ndarray, last: np.ndarray, first: int, o: FileOptions = FileOptions()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (two columns) and the marks of the symbols that end a document. ids are below `first`."""
    sym, last, rules = ids.astype(np.uint32), last.copy(), []
    total, most = 0, (1 << 16) - 1 - first
    table = np.full(1 << _SLOTS, -1, np.int16)
    while len(sym) > 1 and total < most:
        key = (sym[:-1] << np.uint32(16)) | sym[1:]
        key[last[:-1]] = _NO_PAIR
        ranked = np.sort(key)
        edge = np.flatnonzero(np.append(ranked[1:] != ranked[:-1], ranked[-1] != _NO_PAIR))
        n = np.diff(edge, prepend=-1)
        if len(edge) and ranked[edge[-1]] == _NO_PAIR:
            edge, n = edge[:-1], n[:-1]
        at = np.flatnonzero(n >= 2)
        room = min(o.rules_per_round + int(o.growth * total), most - total)
        want = min(int(o.tried * room) + 1, 1 << 15)
        if len(at) > want:
            at = at[np.argpartition(n[at], len(at) - want)[-want:]]
        chosen = ranked[edge[at[np.argsort(n[at], kind="stable")]]]
        if not len(chosen):
            break
        where, rank = _occurrences(key, chosen, table)
        got = np.bincount(rank, minlength=len(chosen))
        use = got >= 2
        if use.sum() > room:
            use = np.zeros(len(got), bool)
            use[np.argsort(-got, kind="stable")[:room]] = True
        if not use.any():
            break
        mine = use[rank]
        where, rank = where[mine], rank[mine]
        rules.append(np.stack([chosen[use] >> np.uint32(16), chosen[use] & np.uint32(0xFFFF)], 1))
        sym[where] = (np.cumsum(use) - 1 + first + total).astype(np.uint32)[rank]
        total += int(use.sum())
        last[where] = last[where + 1]
        keep = np.ones(len(sym), bool)
        keep[where + 1] = False
        sym, last = sym[keep], last[keep]
    return sym.astype(np.uint16), np.concatenate(rules).astype(np.uint32) if rules else np.zeros((0, 2), np.uint32), last


def _occurrences(key: np.ndarray, chosen: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen pairs (in rising order of frequency) that don't overlap, and which pair it is. Of two overlapping ones the more frequent
    has its place, of a row of one pair every other from the left. The table has one place a slot, all -1 between calls: of two
    pairs in a slot the more frequent one is taken now, the other in a later round."""
    slot = (chosen * _SPREAD) >> np.uint32(32 - _SLOTS)
    table[slot] = np.arange(len(chosen), dtype=np.int16)
    near = key * _SPREAD
    near >>= np.uint32(32 - _SLOTS)
    padded = np.full(len(key) + 2, -1, np.int16)
    rank = padded[1:-1]
    rank[:] = table[near]
    table[slot] = -1
    at = np.flatnonzero(rank >= 0)
    rank[at[chosen[rank[at]] != key[at]]] = -1
    places, pairs = [], []
    for _ in range(2):  # the second time for those whose better neighbour went to a still better one
        win = (rank > padded[:-2]) & (rank >= padded[2:])
        run = np.flatnonzero((rank == padded[:-2]) & (rank >= padded[2:]) & (rank >= 0))
        if len(run):
            new = np.concatenate([[True], run[1:] != run[:-1] + 1])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
            # run has the second and later ones of a row; its first of all is in win unless the one before the row is better
            win[run[(np.arange(len(run)) - begin) % 2 == 1]] = True
        at = np.flatnonzero(win)
        places.append(at)
        pairs.append(rank[at].astype(np.int32))
        padded[at], padded[at + 1], padded[at + 2] = -1, -1, -1
    return np.concatenate(places), np.concatenate(pairs)


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all symbols, one after another, and how many each has."""
    out, owner = symbols.astype(np.int64), np.arange(len(symbols))
    while len(at := np.flatnonzero(out >= first)):
        times = np.ones(len(out), np.int64)
        times[at] = 2
        place = np.cumsum(times)[at] - 2
        pair = rules[out[at] - first]
        out, owner = np.repeat(out, times), np.repeat(owner, times)
        out[place], out[place + 1] = pair[:, 0], pair[:, 1]
    return out.astype(np.uint32), np.bincount(owner, minlength=len(symbols))


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols' expansions, one after another: ids, start and length of each symbol."""
    flat, length = expand(np.arange(first, first + len(rules)), rules, first)
    length = np.concatenate([np.ones(first, np.int64), length])
    return np.concatenate([np.arange(first, dtype=np.uint32), flat]), np.cumsum(length) - length, length


def write_shard(doc_ids: list[int | None], ids: np.ndarray, n: np.ndarray, first: int, o: FileOptions) -> bytes:
    last = np.zeros(len(ids), bool)
    last[np.cumsum(n) - 1] = True
    sym, rules, last = repair(ids, last, first, o)
    ends = np.flatnonzero(last) + 1
    _, _, length = expansions(rules, first)
    null = np.array([x is None for x in doc_ids], np.uint8)
    body = b"".join([np.array([x or 0 for x in doc_ids], "<i8").tobytes(), null.tobytes(), n.astype("<u4").tobytes(), np.diff(np.concatenate([[0], ends])).astype("<u4").tobytes(), rules.astype("<u4").tobytes(), length[first:].astype("<u4").tobytes(), sym.astype("<u2").tobytes()])
    head = np.array([len(n), len(ids), len(sym), len(rules), first, int(null.any()), 0, zlib.crc32(body)], "<u4")
    return b"RPG1" + head.tobytes() + body


class Shard:
    """A shard that was read: any document's ids without those of others."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"RPG1":
            raise ValueError("not a shard of token ids")
        docs, self.n_ids, syms, rules, first, _, _, crc = np.frombuffer(raw, "<u4", 8, 4).tolist()
        body = memoryview(raw)[36:]
        if zlib.crc32(body) != crc:
            raise ValueError("shard is damaged")
        at = 0

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(body, kind, n, at)
            at += x.nbytes
            return x

        ids, null = part("<i8", docs), part("u1", docs)
        self.doc_ids = pa.array(ids, mask=null.astype(bool))
        self.n, self.symbols = part("<u4", docs).astype(np.int64), part("<u4", docs).astype(np.int64)
        self.rules, self.lengths = part("<u4", 2 * rules).reshape(-1, 2), part("<u4", rules)
        self.sym = part("<u2", syms)
        self.begin = np.cumsum(self.symbols) - self.symbols
        self.flat, self.start, self.length = expansions(self.rules, first)

    def decode(self, lo: int, hi: int) -> np.ndarray:
        """The ids of documents lo..hi of the shard."""
        s = self.sym[self.begin[lo] : self.begin[hi - 1] + self.symbols[hi - 1]].astype(np.int64)
        return self.flat[X.runs_gather(self.start[s], self.length[s])]


def write(docs: DataFrame, path: str | None = None, options: FileOptions = FileOptions()) -> DataFrame:
    """The shards of docs, written in the shared folder, in ascending doc_id order by (part, seq); first_id and last_id are the range of known doc_ids."""
    path = path or default_path()
    docs = text_and_id(docs, F.xxhash64(docs["text"].cast("string")).alias("h"))
    order = F.col("doc_id").asc_nulls_first(), F.col("h").asc()
    parts = parts_by_size(docs)
    dealt = (docs.repartitionByRange(parts, *order) if parts else docs.repartitionByRange(*order)).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        part, seq = TaskContext.get().partitionId(), 0
        first = enc.model.get_vocab_size()
        held, names, size = [], [], 0

        def shard() -> pa.RecordBatch:
            ids, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            raw = write_shard(names, ids, n, first, options)
            known = [x for x in names if x is not None]
            row = (part, seq, len(n), len(ids), min(known, default=None), max(known, default=None), len(names) - len(known))
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in row), pa.array([raw], pa.binary())], names=["part", "seq", "docs", "ids", "first_id", "last_id", "null_ids", "shard"])

        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            for s in X.slices(batch.column("text")):
                flat, at = enc.slice(s)
                n = np.diff(at) + 1
                whole = np.full(int(n.sum()), options.end, np.uint32)
                whole[X.runs_gather(np.cumsum(n) - n, n - 1)] = flat
                held.append((whole, n))
                names += own[s.lo : s.hi]
                size += len(whole)
                if size >= options.shard_ids:
                    yield shard()
                    seq, held, names, size = seq + 1, [], [], 0
        if names:
            yield shard()

    return cut(dealt.mapInArrow(run, "part long, seq long, docs long, ids long, first_id long, last_id long, null_ids long, shard binary"), "token-shards")


def read_back(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards alone."""
    parts = shards.groupBy("part").agg(F.sum("ids").alias("n"))
    # one row a part: the only sum that one task makes
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    sizes = shards.select("part", "seq", (F.sum("ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("ids")).alias("inner"))
    base = sizes.join(parts, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, raw in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("shard")):
                s = Shard(raw.as_buffer().to_pybytes())
                ids = s.decode(0, len(s.n))
                at = np.concatenate([[0], np.cumsum(s.n)])
                view = memoryview(ids.astype("<u4")).cast("B")
                crc = np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())), np.int64, len(s.n))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s.n), part)), pa.array(np.full(len(s.n), seq)), s.doc_ids, pa.array(at[:-1]), pa.array(s.n), pa.array(crc)], names=["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "seq", "shard").mapInArrow(run, "part long, seq long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def shards_with(shards: DataFrame, doc_id: int | None) -> DataFrame:
    """The shards that may hold a doc_id, by the ranges that stand beside them (Parquet reads no others)."""
    return shards.filter(F.col("null_ids") > 0 if doc_id is None else (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))


def fetch(shards: DataFrame, doc_id: int | None) -> list[list[int]]:
    """The ids of the documents with one doc_id, decoding only their symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("shard"):
                s = Shard(raw.as_buffer().to_pybytes())
                got = [s.decode(i, i + 1) for i, x in enumerate(s.doc_ids.to_pylist()) if x == doc_id]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int64()))], names=["ids"])

    found = shards_with(shards, doc_id).orderBy("part", "seq").select("shard").mapInArrow(run, "ids array<long>")
    return [list(r.ids) for r in found.toLocalIterator()]
