"""Similarity join on word 5-shingles: MinHash candidates, Bayesian pruning, exact verification, classes.

Plan
1. Each document gets a digest of its shingle set and 128 MinHash values in 32 bands of 4 (written as a table). Documents with one
   digest are copies; from here on each digest counts once and carries its number of documents.
2. Digests meet in band buckets. Buckets with the same members are kept once, so a pair is looked at in few of them. At similarity
   0.8 two sets meet in some band with probability 1 - 5e-8.
3. A bucket of m digests is cut into blocks of `block`; each pair of blocks is one group of one task, which holds two blocks at most.
   Pairs are never rows: the task compares MinHash values step by step, drops a pair once the posterior probability (uniform
   prior) that its similarity reaches the threshold is under `tolerance`, and verifies the rest exactly on the shingle sets. A pair belongs to
   the first of its common buckets, so it counts once. What leaves the task is a row per digest: its links and a spanning star.
4. Classes are the components of the stars (large-star / small-star rounds, each written as a table).

Defined cases: words as in benchmark decontamination (A-Z lower-cased); a text of 1 to 4 words is one shingle; null texts and those without
words have the empty set, are copies of each other and link to nothing else; repeated rows are copies of each other; class_id is the
least doc_id of the class (null ids only if all are); an empty table gives an empty result; a similarity of exactly the threshold is a link; very long texts are
shingled whole. n_links of a document counts the other documents with similarity >= threshold, copies included. Other columns pass through keep_one whatever their names.

Hot groups: copies are one digest from the start. A group of m near copies of different text is m / block rows of shingles for each of them, and m * m / 2 pairs,
each compared step by step, in (m / block)**2 / 2 tasks' groups; the pairs are what exact links of different texts cost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravel.llm import textcore as X
from ravel.llm.common import annotate, bits_of, cut, fresh, groups, text_and_id


@dataclass(frozen=True)
class JoinOptions:
    words: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 4
    step: int = 8
    tolerance: float = 1e-6
    block: int = 256
    seed: int = 7


FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in ("rid", "d1", "d2")] + [T.StructField("bands", T.ArrayType(T.LongType()))])
U = np.uint64


def shingles(s: X.Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams (a shorter text: of all its words), and how many come before each document (one more at the end)."""
    data = X.LOWER[s.data]
    starts, ends, before = s.words(X.ALNUM[data])
    h = s.spans_hash(s.prefix(data), starts, ends)
    count = np.diff(before)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out = np.zeros(int(size.sum()), U)
    at = np.concatenate([[0], np.cumsum(size)])
    run = X.windows_hash(h, n)
    long = np.flatnonzero(count >= n)
    out[X.runs_gather(at[long], size[long])] = run[X.runs_gather(before[long], size[long])]
    for k in range(1, n):
        own = np.flatnonzero(count == k)
        if len(own):
            out[at[own]] = X.windows_hash(h, k)[before[own]]
    return out, at


def minhash(sh: np.ndarray, at: np.ndarray, o: JoinOptions) -> np.ndarray:
    """MinHash values of the documents that have shingles (uint32, a row each)."""
    own = np.flatnonzero(np.diff(at))
    k = o.bands * o.rows
    out = np.empty((len(own), k), np.uint32)
    rng = np.random.default_rng(o.seed)
    a = rng.integers(0, 1 << 63, k, dtype=np.uint64) * U(2) + U(1)
    b = rng.integers(0, 1 << 63, k, dtype=np.uint64)
    for i in range(k if len(own) else 0):
        out[:, i] = np.minimum.reduceat(((sh * a[i] + b[i]) >> U(32)).astype(np.uint32), at[own])
    return out


def digests(sh: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Two 64-bit digests of each document's shingle set, and the sets."""
    sets = [X.sorted_unique(sh[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    off = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, U)

    def total(salt: int) -> np.ndarray:
        c = np.concatenate([np.zeros(1, U), np.cumsum(X.mix(flat ^ U(salt)), dtype=U)])
        return X.signed(X.mix(c[off[1:]] - c[off[:-1]] + np.diff(off).astype(U)))

    return total(0x5851F42D4C957F2D), total(0x14057B7EF767814F), sets


def band_keys(sig: np.ndarray, o: JoinOptions) -> np.ndarray:
    v = sig.reshape(len(sig), o.bands, o.rows).astype(U)
    key = np.tile(X.mix(np.arange(1, o.bands + 1, dtype=U)), (len(sig), 1))
    for r in range(o.rows):
        key = X.mix(key ^ v[:, :, r])
    return X.signed(key)


def signatures(docs: DataFrame, o: JoinOptions, name: str, drop_text: bool) -> DataFrame:
    """docs with the struct `name` of FIELDS, as a written table: rid is a number of the row, d1 and d2 the digest; no bands without words."""
    count = {}

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        part = TaskContext.get().partitionId()
        first = count.get(part, 0)
        count[part] = first + batch.num_rows
        d1, d2, bands, empty = [], [], [], []
        for s in X.slices(batch.column("text")):
            sh, at = shingles(s, o.words)
            a, b, _ = digests(sh, at)
            none = np.diff(at) == 0
            keys = np.zeros((s.docs, o.bands), np.int64)
            keys[~none] = band_keys(minhash(sh, at, o), o)
            d1.append(a), d2.append(b), bands.append(keys), empty.append(none)
        none = np.concatenate(empty)
        rows = np.concatenate([[0], np.cumsum(np.where(none, 0, o.bands))]).astype(np.int32)
        return [
            pa.array((part << 40) + first + np.arange(len(none), dtype=np.int64)),
            pa.array(np.concatenate(d1)),
            pa.array(np.concatenate(d2)),
            pa.ListArray.from_arrays(pa.array(rows), pa.array(np.concatenate(bands)[~none].ravel())),
        ]

    return cut(annotate(docs, name, FIELDS, work, drop_text=drop_text), "signatures")


def least_matches(o: JoinOptions) -> list[tuple[int, int]]:
    """After n values, how many must agree for the posterior probability of similarity >= threshold to reach the tolerance.

    With a uniform prior and m of n in agreement the posterior is Beta(m + 1, n - m + 1), whose tail at t is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(o.step, o.bands * o.rows + 1, o.step):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * o.threshold**m * (1 - o.threshold) ** (n + 1 - m)
            if total >= o.tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def linked(key_band: int, left: dict, right: dict | None, o: JoinOptions, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The verified pairs (positions in left and right; within left if right is None) that belong to this bucket."""
    other = left if right is None else right
    got_i, got_j = [], []
    rows = max(1, 65536 // max(1, len(other["n"])))
    for lo in range(0, len(left["n"]), rows):
        i = np.repeat(np.arange(lo, min(lo + rows, len(left["n"]))), len(other["n"]))
        j = np.tile(np.arange(len(other["n"])), len(i) // max(1, len(other["n"])))
        if right is None:
            i, j = i[i < j], j[i < j]
        a, b = left["n"][i], other["n"][j]
        near = np.minimum(a, b) >= o.threshold * np.maximum(a, b)
        i, j = i[near], j[near]
        same = np.zeros(len(i), np.int64)
        for n, least in steps:
            same += (left["sig"][i, n - o.step : n] == other["sig"][j, n - o.step : n]).sum(1)
            alive = same >= least
            i, j, same = i[alive], j[alive], same[alive]
        if len(i):
            eq = (left["sig"][i] == other["sig"][j]).reshape(len(i), o.bands, o.rows).all(2)
            eq &= (left["mask"][i][:, None] >> np.arange(o.bands)) & 1 != 0
            mine = eq.argmax(1) == key_band
            got_i.append(i[mine]), got_j.append(j[mine])
    if not got_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(got_i), np.concatenate(got_j)
    common = _common_dense(left["sh"], other["sh"], i, j) if len(i) > 2000 else _common(left["sh"], other["sh"], i, j)
    ok = common >= o.threshold * (left["n"][i] + other["n"][j] - common) - 1e-9
    return i[ok], j[ok]


def _common(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i), np.int64)
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        both = np.sort(np.concatenate([a[x], b[y]]))
        out[k] = int((both[1:] == both[:-1]).sum())
    return out


def _common_dense(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of many intersections as matrix products over the shingles that several sets have."""
    sets = a if a is b else [*a, *b]
    flat = np.concatenate(sets)
    keys, n = X.sorted_counts(flat)
    keys = keys[n > 1]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    col = np.searchsorted(keys, flat)
    ok = col < len(keys)
    ok[ok] = keys[col[ok]] == flat[ok]
    row, col = row[ok], col[ok]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    shift = 0 if a is b else len(a)
    total = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(keys), 4096):
        x, y = np.searchsorted(col, [lo, lo + 4096])
        m = np.zeros((len(sets), min(4096, len(keys) - lo)), np.float32)
        m[row[x:y], col[x:y] - lo] = 1
        total += m[: len(a)] @ m[shift:].T
    return total[i, j].astype(np.int64)


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least position of each one's component under the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(docs: DataFrame, table: DataFrame, name: str, o: JoinOptions) -> tuple[DataFrame, DataFrame]:
    """For each digest its first document and number of documents; and for each linked digest its links and a star edge."""
    digest = table.select(F.col(f"{name}.d1").alias("d1"), F.col(f"{name}.d2").alias("d2"), F.col("doc_id"), F.col(f"{name}.bands").alias("bands"))
    reps = digest.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"), F.first("bands").alias("bands"))
    reps = cut(reps.withColumn("node", _node("first_doc", "d1", "d2")), "digests")
    bands = reps.select("d1", "d2", F.posexplode("bands").alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("d1", "d2")).alias("x1"), F.bit_xor(F.xxhash64("d2", "d1", F.lit(1))).alias("x2")).filter("m > 1")
    kept = buckets.groupBy("m", "x1", "x2").agg(F.min("key").alias("key")).select("key", "m")
    members = cut(bands.join(kept, "key"), "buckets")
    masks = members.groupBy("d1", "d2").agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("mask"))
    bits = docs.sparkSession.sparkContext.broadcast(bits_of(masks, "d1"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for s in X.slices(batch.column("text")):
                sh, at = shingles(s, o.words)
                d1, d2, own = digests(sh, at)
                want = bits.value.may_have(d1) & (np.diff(at) > 0)
                for i in np.flatnonzero(want).tolist():
                    k = (int(d1[i]), int(d2[i]))
                    want[i] = k not in seen
                    if len(seen) < 1 << 16:  # only spares the shuffle a copy; the aggregation below removes all
                        seen.add(k)
                at_once = np.flatnonzero(want)
                if len(at_once):
                    some = np.concatenate([[0], np.cumsum(np.diff(at)[at_once])])
                    sig = minhash(sh[X.runs_gather(at[at_once], np.diff(at)[at_once])], some, o)
                    yield pa.RecordBatch.from_arrays([pa.array(d1[at_once]), pa.array(d2[at_once]), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([own[i].tobytes() for i in at_once], pa.binary())], names=["d1", "d2", "sig", "sh"])

    found = docs.select("text").mapInArrow(sets, "d1 long, d2 long, sig binary, sh binary")
    found = found.groupBy("d1", "d2").agg(F.first("sig").alias("sig"), F.first("sh").alias("sh"))
    found = found.join(masks, ["d1", "d2"]).join(reps.select("d1", "d2", "n_docs", "node"), ["d1", "d2"])
    blocks = F.ceil(F.col("m") / o.block).cast("int")
    rows = (
        members.join(found, ["d1", "d2"])
        .withColumn("own", F.pmod(F.xxhash64("d1", "d2"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "band", "d1", "d2", "mask", "n_docs", "node", "sig", "sh")
    )
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "d1", "d2")
    steps = least_matches(o)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi), t in groups(batches, ["key", "lo", "hi"]):
            all_ = _side(t)
            if lo == hi:
                i, j = linked(int(t["band"][0].as_py()), all_, None, o, steps)
            else:
                own = np.asarray(t["own"])
                at_l, at_r = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
                i, j = linked(int(t["band"][0].as_py()), _pick(all_, at_l), _pick(all_, at_r), o, steps)
                i, j = at_l[i], at_r[j]
            if len(i):
                n = len(all_["n"])
                add = np.bincount(i, all_["docs"][j], n) + np.bincount(j, all_["docs"][i], n)
                root = stars(n, i, j)
                at = np.flatnonzero(add)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (all_["d1"][at], all_["d2"][at], add[at].astype(np.int64), all_["node"][at], all_["node"][root[at]])], names=["d1", "d2", "links", "u", "v"])

    return reps, cut(rows.mapInArrow(run, "d1 long, d2 long, links long, u string, v string"), "links")


def _side(t: pa.Table) -> dict:
    t = t.combine_chunks()
    sh = [np.frombuffer(x, np.uint64) for x in t["sh"].to_pylist()]
    return {"d1": np.asarray(t["d1"]), "d2": np.asarray(t["d2"]), "docs": np.asarray(t["n_docs"]), "node": np.array(t["node"].to_pylist(), object), "mask": np.asarray(t["mask"]), "n": np.array([len(x) for x in sh], np.int64), "sig": np.stack([np.frombuffer(x, np.uint32) for x in t["sig"].to_pylist()]), "sh": sh}


def _pick(side: dict, at: np.ndarray) -> dict:
    return {k: [v[i] for i in at] if isinstance(v, list) else v[at] for k, v in side.items()}


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each component, for edges (u, v) of strings. Rounds go on until nothing changes; their number is logarithmic in the
    longest path, and each is a written table."""
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        edges = cut(small, "edges")
        new = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == state:
            break
        state = new
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()


def _node(first_doc: str, a: str, b: str) -> Column:
    """A digest's name; names sort by the first document's id (null last), so that the least name of a class has its class_id in it."""
    known = F.concat(F.lpad(F.hex(F.col(first_doc).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit(":"), F.col(first_doc).cast("string"))
    return F.concat_ws(":", F.coalesce(known, F.lit("none:")), F.hex(a), F.hex(b))


def _first_doc(node: str) -> Column:
    return F.expr(f"try_cast(split_part({node}, ':', 2) as long)")


def classes(docs: DataFrame, table: DataFrame, name: str, o: JoinOptions) -> DataFrame:
    """d1, d2, node, root (the digest's own node without links), n_docs, links of every digest."""
    reps, made = links(docs, table, name, o)
    node = components(made.select("u", "v")).select(F.col("node").alias("u"), "root")
    total = made.groupBy("d1", "d2", "u").agg(F.sum("links").alias("links")).join(node, "u").drop("u")
    return reps.select("d1", "d2", "node", "n_docs").join(total, ["d1", "d2"], "left").withColumn("root", F.coalesce("root", "node"))


def similarity_join(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """doc_id, class_id, n_links: a row for each row of docs (doc_id, text)."""
    docs = text_and_id(docs)
    table = signatures(docs, options, "near", drop_text=True)
    each = classes(docs, table, "near", options)
    each = cut(each.select("d1", "d2", _first_doc("root").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links")), "classes")
    rows = table.select("doc_id", F.col("near.d1").alias("d1"), F.col("near.d2").alias("d2"))
    return rows.join(each, ["d1", "d2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """One row of each class, that with the least doc_id, with its own columns."""
    name = fresh(docs.columns, "near_join")
    table = signatures(docs, options, name, drop_text=False)
    slim = table.select("doc_id", "text", name)
    each = classes(slim, slim, name, options).select("d1", "d2", "root")
    rows = slim.select(F.struct("doc_id", f"{name}.rid").alias("who"), F.col(f"{name}.d1").alias("d1"), F.col(f"{name}.d2").alias("d2"))
    # copies first, with partial sums, so that a large group of copies is a few rows before the classes meet
    first = rows.groupBy("d1", "d2").agg(F.min("who").alias("who")).join(each, ["d1", "d2"]).groupBy("root").agg(F.min("who").alias("who"))
    stay = first.select(F.col("who.rid").alias("rid"))
    return table.join(stay, table[f"{name}.rid"] == stay["rid"], "left_semi").drop(name)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9
  UNION ALL SELECT a.doc_id, b.doc_id FROM w a JOIN w b ON len(a.w) = 0 AND len(b.w) = 0 AND a.doc_id < b.doc_id),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen),
k AS (SELECT node, min(seen) AS class_id FROM r GROUP BY node),
m AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT d.doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM documents d JOIN k ON k.node = d.doc_id LEFT JOIN m ON m.x = d.doc_id
"""
