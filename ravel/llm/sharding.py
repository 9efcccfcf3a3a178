"""Sharding: size-tiered compaction of immutable shards under a versioned manifest, with DataFrame operations only.

A store is a folder: data/<run>/ holds Parquet files that are never changed, manifests/v<number>.json says what a version adds to and takes from the one before,
and every `snapshot`th lists all files, so that a commit writes what has changed and a reader opens `snapshot` manifests at most. append() writes
arrivals as small shards, as many as the input has tasks, without a shuffle. compact() sorts shards below the target into tiers by size (each tier
`ratio` times the one below), and merges the run of every tier that has `fan_in` shards or more into files of about the target size; a
merge reads its files and writes them through coalesce(), so no row is shuffled or seen by Python. Each step ends in one commit: the manifest
is written beside and renamed to the next version, which fails if that version is there, so of two writers one wins and readers see a whole
version or the one before. Files of lost tasks and lost races are in no manifest; vacuum() removes them.

The driver holds a line per shard (path, bytes, rows), nothing per row.

Defined cases: an empty table commits a version without new shards; nulls, repeated rows, extra columns of any name and very long texts (a row is never cut) are kept as they
are; shards of one size and one path order are merged in the order of their paths; the schema of the first append holds, and later ones must have it.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class StoreOptions:
    target_bytes: int = 128 << 20
    least_bytes: int = 64 << 10
    ratio: int = 4
    fan_in: int = 4
    compression: str = "zstd"
    snapshot: int = 16


class Conflict(RuntimeError):
    """Another writer committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, options: StoreOptions = StoreOptions()):
        self.spark, self.root, self.o = spark, root.rstrip("/"), options
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    # manifests

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/manifests")
        if not self.fs.exists(at):
            return []
        names = (x.getPath().getName() for x in self.fs.listStatus(at))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _load(self, version: int) -> dict:
        stream = self.fs.open(self._path(f"{self.root}/manifests/v{version:012d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def manifest(self, version: int | None = None) -> dict:
        """The given version, or the newest; version 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        shards: dict[str, dict] = {}
        later = []
        for v in range(version, 0, -1):
            m = self._load(v)
            later.append(m)
            if "shards" in m:
                break
        for m in reversed(later):
            shards.update((s["path"], s) for s in m.get("shards", m["add"]))
            for path in m["remove"]:
                shards.pop(path, None)
        return {"version": version, "schema": later[0]["schema"] if later else None, "shards": [shards[p] for p in sorted(shards)]}

    def commit(self, base: dict, shards: list[dict], schema: str | None) -> dict:
        """Make the next version after base; Conflict if there is one."""
        new = {"version": base["version"] + 1, "schema": schema, "shards": sorted(shards, key=lambda s: s["path"])}
        had, has = ({s["path"] for s in x["shards"]} for x in (base, new))
        line = {"version": new["version"], "schema": schema, "add": [s for s in new["shards"] if s["path"] not in had], "remove": sorted(had - has)}
        if new["version"] % self.o.snapshot == 0:
            line["shards"] = new["shards"]
        side = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        final = self._path(f"{self.root}/manifests/v{new['version']:012d}.json")
        self.fs.mkdirs(side.getParent())
        out = self.fs.create(side, False)
        try:
            out.write(json.dumps(line).encode())
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(side.getParent().toUri() if side.toUri().getScheme() else self.fs.getUri(), self.conf).rename(side, final, none)
        except Exception as e:
            self.fs.delete(side, False)
            if self.fs.exists(final):
                raise Conflict(f"version {new['version']} is there already") from e
            raise
        return new

    # shards

    def _write(self, df: DataFrame) -> list[dict]:
        """Write df as a new run; a line for each of its files."""
        run = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", self.o.compression).parquet(f"{self.root}/{run}")
        m = F.col("_metadata")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.root}/{run}").groupBy(m["file_name"].alias("file"), m["file_size"].alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))
        return [{"path": f"{run}/{r['file']}", "bytes": r["bytes"], "rows": r["rows"]} for r in rows.collect()]

    def append(self, df: DataFrame) -> dict:
        """Commit the rows of df as new shards."""
        base = self.manifest()
        schema = df.schema.json()
        if base["schema"] and [(f.name, f.dataType) for f in T.StructType.fromJson(json.loads(base["schema"]))] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError("the store has another schema")
        return self.commit(base, base["shards"] + self._write(df), base["schema"] or schema)

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.o.least_bytes, self.o.ratio)))

    def runs(self, shards: list[dict]) -> list[list[dict]]:
        """The runs of similarly sized shards that are due for a merge."""
        by: dict[int, list[dict]] = defaultdict(list)
        for s in shards:
            if s["bytes"] < self.o.target_bytes // 2:
                by[self.tier(s["bytes"])].append(s)
        return [v for _, v in sorted(by.items()) if len(v) >= self.o.fan_in]

    def _read(self, manifest: dict, shards: list[dict]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{s['path']}" for s in shards))

    def compact(self) -> dict:
        """Merge until no tier has a run that is due; a commit for each round."""
        now = self.manifest()
        while due := self.runs(now["shards"]):
            kept, gone = list(now["shards"]), set()
            for run in due:
                files = max(1, round(sum(s["bytes"] for s in run) / self.o.target_bytes))
                if files >= len(run):
                    continue
                made = self._write(self._read(now, run).coalesce(files))
                gone |= {s["path"] for s in run}
                kept += made
            if not gone:
                break
            now = self.commit(now, [s for s in kept if s["path"] not in gone], now["schema"])
        return now

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m["schema"]:
            raise ValueError("the store is empty")
        return self._read(m, m["shards"])

    def vacuum(self, keep_versions: int = 1) -> int:
        """Remove files that the newest keep_versions versions do not list; how many. Not while another writer is at work."""
        kept = {s["path"] for v in self.versions()[-keep_versions:] for s in self.manifest(v)["shards"]}
        n = 0
        data = self._path(f"{self.root}/data")
        for run in self.fs.listStatus(data) if self.fs.exists(data) else []:
            for f in self.fs.listStatus(run.getPath()):
                name = f"data/{run.getPath().getName()}/{f.getPath().getName()}"
                if f.getPath().getName().endswith(".parquet") and name not in kept:
                    self.fs.delete(f.getPath(), False)
                    n += 1
        return n


#: A store that merged nothing has merged = false.
ORACLE = "SELECT doc_id, md5(text) AS text_md5, CAST(strlen(text) AS BIGINT) AS n_bytes, lang, source, true AS merged, count(*) OVER () AS manifest_rows FROM documents"
