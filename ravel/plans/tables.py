"""Written intermediate tables: lineage ends there, and what several branches of a plan read is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; a temporary one only where that is unset on a single machine."""
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


def materialise(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
