"""Spark helpers shared by the corpus operators: shared tables, column names, streamed groups, bounded bit filters."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; where that is unset (tests on one machine) a temporary one."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        got = current.get() if current.isDefined() else None
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = tempfile.mkdtemp(prefix="ravel-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


#: Arrow batches that Python workers get: rows and bytes at most.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what the JVM and a worker hold of one task's rows at once. The session's own smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: Bytes of a plan that one task of a sort by ranges takes.
PART_BYTES = 128 << 20


def parts_by_size(df: DataFrame) -> int | None:
    """So many parts that each has PART_BYTES by the plan's own estimate; None if the session's number of shuffle partitions is as many."""
    need = math.ceil(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / PART_BYTES)
    # a plan without statistics counts as 2**63 bytes
    return need if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) < need < 1 << 24 else None


def cut(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and lost executors cost nothing before it. What is packed already is best
    written without compression."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that cut() wrote, once all that is made from it is written itself."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(names: Iterable[str], wanted: str) -> str:
    """wanted, or with underscores before it until no column has that name (in any case)."""
    have = {n.lower() for n in names}
    while wanted.lower() in have:
        wanted = f"_{wanted}"
    return wanted


def free_name(df: DataFrame, name: str) -> None:
    """ValueError if df has a column of that name (in any case)."""
    if fresh(df.columns, name) != name:
        raise ValueError(f"there is a column {name} already; give the result another name")


def text_and_id(df: DataFrame, *more: Column) -> DataFrame:
    """Only doc_id (long) and text (string), and what else is asked for: other columns never meet those of an operator."""
    small_batches(df.sparkSession)
    return df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text"), *more)


def crc_mod(column: Column | str, m: int) -> Column:
    """crc32 of a key as text, mod m (null keys: null)."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % m


def annotate(df: DataFrame, name: str, fields: T.StructType, work: Callable[[pa.RecordBatch], list[pa.Array]], text: str = "text", drop_text: bool = False) -> DataFrame:
    """Add a struct column `name` of `fields`, which `work` computes from each Arrow batch; other columns pass unchanged."""
    small_batches(df.sparkSession)
    free_name(df, name)
    keep = [c for c in df.columns if not (drop_text and c == text)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, fields)])
    names = fields.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.StructArray.from_arrays(made, names)], names=[*keep, name])

    return df.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of consecutive rows with equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(at, at[1:]):
            key = tuple(c[a].item() for c in cols)
            if last is not None and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


class Bits:
    """A bit filter over 64-bit hashes with a fixed number of bits. It may say yes for a hash that was not put in, never no for one that was."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    @classmethod
    def of(cls, h: np.ndarray) -> Bits:
        """The filter of some hashes (uint64), with 16 to 32 bits for each."""
        made = cls(np.zeros(1 << max(6, math.ceil(math.log2(max(1, len(h) / 4)))), np.uint64))
        at = h & made.mask
        np.bitwise_or.at(made.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        return made

    def may_have(self, h: np.ndarray) -> np.ndarray:
        at = h.view(np.uint64) & self.mask
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def marked_by(bits: Bits, key: Column, spark: SparkSession) -> Column:
    """Whether the filter may have the key (a long), by rows. Only the key goes to Python."""
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def has(k: pa.Array) -> pa.Array:
        return pa.array(shared.value.may_have(np.asarray(k.fill_null(0), np.int64)))

    return has(key)


def bits_of(df: DataFrame, column: str, most_bits: int = 1 << 26) -> Bits:
    """The bit filter of a column of longs. It has about 16 bits a row, `most_bits` at most, so that the driver and the
    broadcast hold 8 MB at most at any input size; with more rows it lets more through, and the exact join that always
    follows has more to do."""
    n = df.count()
    bits = min(most_bits, max(1 << 12, 1 << math.ceil(math.log2(16 * max(n, 1)))))
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    rows = df.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = rows.toArrow()
    words = np.zeros(bits // 64, np.uint64)
    if got.num_rows:
        words[np.asarray(got["w"])] = np.asarray(got["b"]).view(np.uint64)
    return Bits(words)

