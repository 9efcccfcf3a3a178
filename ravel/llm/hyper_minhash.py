"""Near duplicates by HyperMinHash: compressed registers, bands, a corrected estimate, exact confirmation, components.

Plan
1. Each document's set of word shingles gets a digest and `buckets` registers (a written table). A shingle's 64-bit hash names its bucket by its top bits; of the rest
   a register keeps what the least value of its bucket shows: the number of leading zeros (6 bits) and the `mantissa` bits behind the first one. That is 16 bits a
   bucket at any set size. Documents with one digest have one set; from here on each digest counts once.
2. Banding: `rows` registers make a band's key. An empty register borrows from the first filled one in an order of its own, so that two sets still agree there with
   the probability of their similarity. At 0.85 two sets meet in none of 32 bands of 4 with probability 6e-11.
3. Stars first: in each bucket of a band the member of least digest is the leader, and everyone is compared with the `leaders` least of its leaders only, each pair
   once whatever the number of common bands. A leader's members are dealt over shares of `block` rows. What is confirmed makes components; a large group of near
   copies, whatever its size, comes down to a few of them at a cost in proportion to its rows. In buckets of more than `block` members that still lie in several
   components, whoever is not in the largest is compared with `leaders` members of it, chosen by hash, in two of its buckets, `rounds` times.
4. The rest exactly: buckets whose members lie in two components or more are looked at again. Their largest component and the others are cut into blocks; blocks of
   others meet each other and those of the largest, never those of one component with itself. In a task, pairs of one component are passed over, and each confirmed
   link joins two on the spot, so that few pairs of a dense group are confirmed one by one. Pairs are never rows: a task yields a tree of links.
5. Before confirmation a pair's registers give an estimate: the share of equal ones among those filled in either, less the expected chance collisions of
   compressed registers of such loads. It is dropped if a pair at the threshold would fall so low with a probability under `tolerance`.
   Confirmation counts the common shingles of both full sets, as 64-bit hashes (as many of a set collide with probability n * n / 4e19).
6. Components of all links (graph.py); the least doc_id of a component is its name.

Defined cases: words are [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased; a text of one or two words is one shingle; null texts and those without words have an empty set
and are linked with nothing, copies neither; repeated rows have one digest; a null doc_id is never the least unless there is no other, kept is then true as both are
null; a similarity of exactly the threshold is a link; very long texts are shingled whole; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravel.llm import textcore as X
from ravel.llm.common import annotate, bits_of, cut, groups, marked_by, text_and_id
from ravel.llm.graph import components
from ravel.llm.near_join import digests

U = np.uint64


@dataclass(frozen=True)
class HyperOptions:
    words: int = 3
    #: Similarity in hundredths.
    percent: int = 85
    buckets: int = 128
    rows: int = 4
    mantissa: int = 10
    tolerance: float = 1e-9
    leaders: int = 3
    rounds: int = 2
    block: int = 1024
    #: A set of more shingles counts as several in a block.
    heavy: int = 4096

    @property
    def bands(self) -> int:
        return self.buckets // self.rows


FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in ("d1", "d2", "n")] + [T.StructField("bands", T.ArrayType(T.LongType()))])


def shingles(s: X.Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams (of fewer words: of all), and how many come before each document (one more at the end)."""
    data = X.LOWER[s.data]
    starts, ends, before = s.words(X.NOT_SPACE[data])
    h = s.spans_hash(s.prefix(data), starts, ends)
    count = np.diff(before)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(at[-1]), U)
    full = X.windows_hash(h, n)
    for k in range(1, n + 1):
        own = np.flatnonzero(count >= n) if k == n else np.flatnonzero(count == k)
        if len(own):
            run = full if k == n else X.windows_hash(h, k)
            out[X.runs_gather(at[own], size[own])] = run[X.runs_gather(before[own], size[own])]
    return out, at


@lru_cache
def _borrowing(buckets: int) -> np.ndarray:
    """For each bucket the others in the order in which it borrows from them."""
    rng = np.random.default_rng(11)
    return np.stack([rng.permutation(buckets) for _ in range(buckets)])


def registers(sets: list[np.ndarray], o: HyperOptions) -> np.ndarray:
    """The registers of non-empty sets, a row each (uint16); 0 is an empty bucket."""
    n = np.array([len(x) for x in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, U)
    h = X.mix(flat ^ U(0x9FB21C651E98DF25))
    low = 64 - (o.buckets - 1).bit_length()
    slot = (h >> U(low)).astype(np.int64)
    least = np.full((len(sets), o.buckets), U(1) << U(low), U)
    np.minimum.at(least, (np.repeat(np.arange(len(sets)), n), slot), h & U((1 << low) - 1))
    filled = least < U(1) << U(low)
    # leading zeros among the low bits, exactly: a float's exponent could be rounded up
    width = np.zeros(least.shape, np.int64)
    rest = least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >> U(step) > 0
        width += big * step
        rest = np.where(big, rest >> U(step), rest)
    width += rest > 0  # bits of the value
    zeros = np.minimum(low - width, 62)
    # the bits behind the first one, at the top of `mantissa` bits
    shift = width - 1 - o.mantissa
    part = np.where(shift >= 0, least >> np.maximum(shift, 0).astype(U), least << np.maximum(-shift, 0).astype(U)) & U((1 << o.mantissa) - 1)
    return np.where(filled, ((zeros + 1) << o.mantissa) | part.astype(np.int64), 0).astype(np.uint16)


def band_keys(reg: np.ndarray, o: HyperOptions) -> np.ndarray:
    """A key for each band, with empty registers borrowed."""
    reg = reg.copy()
    own = reg > 0
    order = _borrowing(o.buckets)
    doc, slot = np.nonzero(~own)
    for k in range(o.buckets):
        if not len(doc):
            break
        other = order[slot, k]
        ok = own[doc, other]
        reg[doc[ok], slot[ok]] = reg[doc[ok], other[ok]]
        doc, slot = doc[~ok], slot[~ok]
    v = reg.reshape(len(reg), o.bands, o.rows).astype(U)
    key = np.tile(X.mix(np.arange(1, o.bands + 1, dtype=U)), (len(reg), 1))
    for r in range(o.rows):
        key = X.mix(key ^ v[:, :, r])
    return X.signed(key)


@lru_cache(maxsize=4096)
def _chance(a: int, b: int, buckets: int, mantissa: int) -> float:
    """The probability that two registers of unrelated sets with 2**(a/4) and 2**(b/4) shingles are equal and filled: over all values of a register, the product
    of the probabilities that the least of either bucket (Poisson loads) falls there."""
    x, y = 2 ** (a / 4) / buckets, 2 ** (b / 4) / buckets
    zeros = np.arange(1, 40)[:, None]
    edge = (2.0**-zeros) * (1 + np.arange((1 << mantissa) + 1)[None, :] / (1 << mantissa))
    p = -np.diff(np.exp(-x * edge), axis=1)
    q = -np.diff(np.exp(-y * edge), axis=1)
    return float((p * q).sum())


def chance(n: np.ndarray, m: np.ndarray, o: HyperOptions) -> np.ndarray:
    """Expected share of equal registers by chance, for pairs of set sizes."""
    a, b = np.rint(4 * np.log2(n)).astype(int), np.rint(4 * np.log2(m)).astype(int)
    pairs, at = np.unique(np.stack([a, b], 1), axis=0, return_inverse=True)
    return np.array([_chance(int(x), int(y), o.buckets, o.mantissa) for x, y in pairs])[at.ravel()] if len(pairs) else np.zeros(0)


@lru_cache
def least_equal(o: HyperOptions) -> np.ndarray:
    """Of n filled registers, how many must be equal for a pair at the threshold not to be less likely than `tolerance` to have so few."""
    t = o.percent / 100
    out = [0]
    for n in range(1, o.buckets + 1):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n, m) * t**m * (1 - t) ** (n - m)
            if total >= o.tolerance:
                break
            m += 1
        out.append(m)
    return np.array(out)


def likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, o: HyperOptions) -> np.ndarray:
    """Which pairs (registers a and b, set sizes n and m) may reach the threshold: by size, then by the corrected estimate."""
    ok = 100 * np.minimum(n, m) >= o.percent * np.maximum(n, m)
    at = np.flatnonzero(ok)
    if len(at):
        x, y = a[at], b[at]
        filled = ((x > 0) | (y > 0)).sum(1)
        equal = ((x == y) & (x > 0)).sum(1)
        estimate = equal - chance(n[at], m[at], o) * o.buckets
        ok[at] = estimate >= least_equal(o)[filled] - 1
    return ok


def confirmed(a: np.ndarray, b: np.ndarray, o: HyperOptions) -> bool:
    """Whether two sets (sorted, distinct) reach the threshold."""
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= o.percent * (len(a) + len(b) - common)


def _table(docs: DataFrame, o: HyperOptions) -> DataFrame:
    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for s in X.slices(batch.column("text")):
            a, b, sets = digests(*shingles(s, o.words))
            some = [i for i, x in enumerate(sets) if len(x)]
            keys = np.zeros((s.docs, o.bands), np.int64)
            keys[some] = band_keys(registers([sets[i] for i in some], o), o)
            for c, x in zip(cols, (a, b, np.array([len(x) for x in sets], np.int64), keys)):
                c.append(x)
        d1, d2, n, keys = (np.concatenate(c) for c in cols)
        rows = np.concatenate([[0], np.cumsum(np.where(n > 0, o.bands, 0))]).astype(np.int32)
        return [pa.array(d1), pa.array(d2), pa.array(n), pa.ListArray.from_arrays(pa.array(rows), pa.array(keys[n > 0].ravel()))]

    made = annotate(text_and_id(docs), "hyper", FIELDS, work, drop_text=True)
    return cut(made.select("doc_id", "hyper.*"), "registers")


def _sets(docs: DataFrame, wanted: DataFrame, o: HyperOptions) -> DataFrame:
    """d1, d2, reg, sh, node of the digests in wanted (d1, d2, node), as a written table."""
    bits = docs.sparkSession.sparkContext.broadcast(bits_of(wanted, "d1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for s in X.slices(batch.column("text")):
                d1, d2, sets = digests(*shingles(s, o.words))
                at = []
                for i in np.flatnonzero(bits.value.may_have(d1)).tolist():
                    k = (int(d1[i]), int(d2[i]))
                    if len(sets[i]) and k not in seen:
                        at.append(i)
                        if len(seen) < 1 << 16:  # only spares the shuffle a copy; the aggregation below removes all
                            seen.add(k)
                if at:
                    reg = registers([sets[i] for i in at], o)
                    yield pa.RecordBatch.from_arrays([pa.array(d1[at]), pa.array(d2[at]), pa.array([x.tobytes() for x in reg], pa.binary()), pa.array([sets[i].tobytes() for i in at], pa.binary())], names=["d1", "d2", "reg", "sh"])

    found = text_and_id(docs).select("text").mapInArrow(run, "d1 long, d2 long, reg binary, sh binary")
    found = found.groupBy("d1", "d2").agg(F.first("reg").alias("reg"), F.first("sh").alias("sh"))
    return cut(found.join(wanted, ["d1", "d2"]), "sets")


def _side(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    sh = [np.frombuffer(x, U) for x in t["sh"].to_pylist()]
    reg = np.stack([np.frombuffer(x, np.uint16) for x in t["reg"].to_pylist()])
    return reg, sh, np.array([len(x) for x in sh], np.int64), np.array(t["node"].to_pylist(), object)


_LINKS = "u string, v string"


def _links(u: list, v: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string())], names=["u", "v"])


def star_links(pairs: DataFrame, sets: DataFrame, o: HyperOptions) -> DataFrame:
    """Confirmed links of pairs (a1, a2: a leader's digest; d1, d2: a member's; m: the size of their bucket). A leader's members are dealt over shares, and a
    task holds the leader and a batch of members at a time."""
    pairs = cut(pairs.withColumn("share", F.pmod(F.xxhash64("d1", "d2"), F.ceil(F.col("m") / o.block)).cast("int")).drop("m"), "stars")
    leaders = pairs.select("a1", "a2", F.col("a1").alias("d1"), F.col("a2").alias("d2"), "share", F.lit(0).alias("side")).distinct()
    rows = pairs.withColumn("side", F.lit(1)).select(*leaders.columns).unionByName(leaders).join(sets, ["d1", "d2"]).drop("d1", "d2")
    rows = rows.repartition("a1", "a2", "share").sortWithinPartitions("a1", "a2", "share", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = None
        for batch in filter(lambda b: b.num_rows, batches):
            t = pa.Table.from_batches([batch])
            reg, sh, n, node = _side(t)
            heads = np.flatnonzero(np.asarray(t["side"]) == 0).tolist()
            # members before the first leader of a batch belong to the last one of the batch before
            for head, a, b in zip([None, *heads], [0, *(i + 1 for i in heads)], [*heads, len(n)]):
                if head is not None:
                    leader = (reg[head : head + 1], sh[head].copy(), n[head : head + 1], node[head])
                if a < b:
                    r, s, size, name = leader
                    ok = np.flatnonzero(likely(np.repeat(r, b - a, 0), reg[a:b], np.repeat(size, b - a), n[a:b], o)) + a
                    found = [i for i in ok.tolist() if confirmed(s, sh[i], o)]
                    if found:
                        yield _links([name] * len(found), node[found].tolist())

    return cut(rows.mapInArrow(run, _LINKS), "links")


def _labelled(members: DataFrame, known: DataFrame) -> DataFrame:
    """members with root, the least node of what is known of their component, as a written table."""
    return cut(members.join(known, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")


def _mixed(rows: DataFrame, weight: Column) -> DataFrame:
    """key, all (the weight of a bucket), most (its largest component) and w (the weight of that) of buckets with several components."""
    parts = rows.groupBy("key", "root").agg(F.sum(weight).alias("w"))
    mixed = parts.groupBy("key").agg(F.sum("w").alias("all"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("w", "root")).alias("most")).filter("parts > 1")
    return mixed.select("key", "all", F.col("most.root").alias("most"), F.col("most.w").alias("w"))


def second_pairs(members: DataFrame, known: DataFrame, o: HyperOptions, turn: int) -> DataFrame:
    """Pairs for star_links: in large buckets with several components the members outside the largest, and some members of that by a hash of the turn."""
    rows = _labelled(members, known)
    large = cut(_mixed(rows, F.lit(1)).filter(F.col("all") > o.block).select("key", "most", F.col("all").cast("long").alias("m")), "mixed")
    # of the largest component only the members picked go on, so neither join makes a row of its others
    rows = rows.filter(marked_by(bits_of(large.select("key"), "key"), F.col("key"), members.sparkSession))
    pick = Window.partitionBy("key", "root").orderBy(F.xxhash64("d1", "key", F.lit(turn)), "d1", "d2")
    leaders = rows.withColumn("k", F.row_number().over(pick)).filter(F.col("k") <= o.leaders).join(large.select("key", F.col("most").alias("root")), ["key", "root"]).select("key", F.col("d1").alias("a1"), F.col("d2").alias("a2"))
    others = rows.alias("r").join(large.alias("l"), (F.col("r.key") == F.col("l.key")) & (F.col("r.root") != F.col("l.most"))).select("r.key", "r.d1", "r.d2", "l.m")
    # a digest lies in as many buckets as bands at most; those that it is compared in are picked before the join, so that it makes 2 * leaders rows at most
    mine = Window.partitionBy("d1", "d2").orderBy(F.xxhash64("d1", "key", F.lit(turn)), "key")
    others = others.withColumn("k", F.row_number().over(mine)).filter(F.col("k") <= 2).drop("k")
    return others.join(leaders, "key").groupBy("a1", "a2", "d1", "d2").agg(F.max("m").alias("m"))


def rest_links(members: DataFrame, sets: DataFrame, known: DataFrame, o: HyperOptions) -> DataFrame:
    """Links between components (known: node, root) that share a bucket. members: key, d1, node, n (the set's size)."""
    rows = _labelled(members, known)
    # the weight of a set in a block grows with its size, so that a block's sets fit in a task
    mixed = _mixed(rows, F.greatest(F.lit(1.0), F.col("n") / o.heavy))
    mixed = cut(mixed.select("key", "most", F.ceil(F.col("w") / o.block).cast("int").alias("big"), F.ceil((F.col("all") - F.col("w")) / o.block).cast("int").alias("small")), "mixed")
    rows = cut(rows.join(mixed, "key"), "mixed")
    sets = sets.filter(marked_by(bits_of(rows.select("d1").distinct(), "d1"), F.col("d1"), sets.sparkSession))
    large = F.col("root") == F.col("most")
    own = F.when(large, F.pmod(F.xxhash64("node"), "big") + F.col("small")).otherwise(F.pmod(F.xxhash64("node"), "small")).cast("int")
    # blocks 0 .. small-1 are the others, small .. small+big-1 the largest component
    last = F.when(large, F.col("small") - 1).otherwise(F.col("small") + F.col("big") - 1)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "root").join(sets.select("node", "reg", "sh"), "node")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi), t in groups(batches, ["key", "lo", "hi"]):
            reg, sh, n, node = _side(t)
            own = np.asarray(t["own"])
            _, label = np.unique(np.array(t["root"].to_pylist(), object), return_inverse=True)
            u, v = [], []
            for i in np.flatnonzero(own == lo).tolist():
                j = np.flatnonzero((own == hi) & (label != label[i]))
                j = j[j > i] if lo == hi else j
                j = j[likely(np.repeat(reg[i : i + 1], len(j), 0), reg[j], np.full(len(j), n[i]), n[j], o)]
                for x in j.tolist():
                    if label[x] != label[i] and confirmed(sh[i], sh[x], o):
                        label[label == label[x]] = label[i]
                        u.append(node[i]), v.append(node[x])
            if u:
                yield _links(u, v)

    return cut(rows.mapInArrow(run, _LINKS), "links")


def _node(first_doc: str, a: str, b: str) -> Column:
    """A digest's name; names sort by the first document's id (null last), so that a component's least name has its id in it."""
    known = F.concat(F.lpad(F.hex(F.col(first_doc).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit(":"), F.col(first_doc).cast("string"))
    return F.concat_ws(":", F.coalesce(known, F.lit("none:")), F.hex(a), F.hex(b))


def near_duplicates(docs: DataFrame, o: HyperOptions = HyperOptions()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs (doc_id, text)."""
    table = _table(docs, o)
    reps = table.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = cut(reps.select("d1", "d2", _node("first_doc", "d1", "d2").alias("node"), "first_doc", "n", "bands"), "digests")
    bands = reps.select("d1", "d2", "node", "n", F.explode("bands").alias("key"))
    # most keys stand alone and go no further than this count
    again = bits_of(cut(bands.groupBy("key").count().filter("count > 1").select("key"), "keys"), "key")
    bands = cut(bands.filter(marked_by(again, F.col("key"), docs.sparkSession)), "bands")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("d1", "d2")).alias("x1"), F.bit_xor(F.xxhash64("d2", "d1", F.lit(1))).alias("x2"), F.min(F.struct("d1", "d2")).alias("leader")).filter("m > 1")
    # buckets with the same members are one
    shared = shared.groupBy("m", "x1", "x2").agg(F.min(F.struct("key", "leader")).alias("b")).select("b.key", "m", F.col("b.leader.d1").alias("a1"), F.col("b.leader.d2").alias("a2"))
    members = cut(bands.join(shared, "key"), "buckets")
    sets = _sets(docs, cut(members.select("d1", "d2", "node").distinct(), "wanted"), o)
    pairs = members.filter("d1 <> a1 OR d2 <> a2").groupBy("a1", "a2", "d1", "d2").agg(F.max("m").alias("m"))
    # a digest has as many leaders as bands at most
    pairs = pairs.withColumn("k", F.row_number().over(Window.partitionBy("d1", "d2").orderBy("a1", "a2"))).filter(F.col("k") <= o.leaders).drop("k")
    links = star_links(pairs, sets, o)
    known = components(links)
    for turn in range(o.rounds):
        pairs = cut(second_pairs(members.select("key", "d1", "d2", "node"), known, o, turn), "pairs")
        if pairs.isEmpty():
            break
        near = sets.filter(marked_by(bits_of(pairs.select("d1").union(pairs.select("a1")).distinct(), "d1"), F.col("d1"), docs.sparkSession))
        links = links.union(star_links(pairs, near, o))
        known = components(links)
    links = links.union(rest_links(members.select("key", "d1", "node", "n"), sets, known, o))
    known = components(links)
    named = reps.join(known, "node", "left").select("d1", "d2", F.coalesce(F.expr("try_cast(split_part(root, ':', 2) as long)"), "first_doc").alias("component_id"))
    rows = table.join(cut(named, "components"), ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen),
k AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN k ON k.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
