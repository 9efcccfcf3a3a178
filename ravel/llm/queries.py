"""The queries of the corpus operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravel.llm import collocations as op12
from ravel.llm import decontaminate as op5
from ravel.llm import hyper_minhash as op13
from ravel.llm import line_chunks as op4
from ravel.llm import near_join as op3
from ravel.llm import neural_lm as op6
from ravel.llm import packing as op8
from ravel.llm import quality_rules as op1
from ravel.llm import quality_model as op7
from ravel.llm import sharding as op10
from ravel.llm import spelling as op11
from ravel.llm import token_files as op9
from ravel.llm import toxicity as op2
from ravel.llm.common import crc_mod, read, shared_dir, text_and_id


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_and_id(read(spark, sf_dir, "documents"))
    out = op1.quality_rules(docs, op1.trusted_ids(read(spark, sf_dir, "labels")), drop_text=True)
    return out.select("doc_id", "quality_rules.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_and_id(read(spark, sf_dir, "documents"))
    model = op2.fit(docs, read(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0))
    return _judged(op2.score(docs, model, drop_text=True), "toxicity", crc_mod("doc_id", 5) == 0, 0.5)


def _judged(out: DataFrame, name: str, held_out: Column, least: float) -> DataFrame:
    score = F.col(f"{name}.score")
    # a null doc_id is not held out
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score.alias("score"), (score >= least).cast("int").alias("predicted"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.similarity_join(read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op4.line_dedup(text_and_id(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "line_chunks.n_lines", "line_chunks.n_removed_lines", "line_chunks.n_removed_chunks", "line_chunks.n_removed_passages", F.md5(F.col("line_chunks.text").cast("binary")).alias("text_md5"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op5.find(text_and_id(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"), op5.DecontaminationOptions(unnamed=True), drop_text=True).select("doc_id", "decontamination.*")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_and_id(read(spark, sf_dir, "documents"))
    held_out = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    return op6.lm_scores(docs.withColumn("held_out", held_out).withColumn("train", ~held_out))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_and_id(read(spark, sf_dir, "documents"))
    model = op7.fit(docs, read(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2))
    return _judged(op7.score(docs, model, drop_text=True), "quality_model", crc_mod("doc_id", 4) == 2, 0.7)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.pack(text_and_id(read(spark, sf_dir, "documents")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.read_back(op9.write(read(spark, sf_dir, "documents")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of an eighth of the table each, compacted, and read back through the manifest. Eight runs of like size lie in two neighbouring tiers
    at most, so one of them has four, which is due at any scale. merged: the compaction left fewer shards in a later version."""
    docs = read(spark, sf_dir, "documents")
    store = op10.ShardStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    for k in range(8):
        before = store.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == k))
    after = store.compact()
    merged = after["version"] > before["version"] and len(after["shards"]) < len(before["shards"])
    rows = sum(s["rows"] for s in after["shards"])
    out = store.read().select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.octet_length("text").cast("long").alias("n_bytes"), "lang", "source")
    return out.withColumn("merged", F.lit(merged)).withColumn("manifest_rows", F.lit(rows).cast("long"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.variants(read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.collocations(read(spark, sf_dir, "documents"))


def op13_hyper_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.near_duplicates(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and "_" in k and callable(f)}


def oracle_sql() -> dict[str, str]:
    out = {"op3_ngram_jaccard_join": op3.ORACLE, "op4_line_dedup": op4.ORACLE, "op5_benchmark_decontamination": op5.ORACLE, "op10_sharding": op10.ORACLE}
    return out | {"op11_spelling_variants": op11.ORACLE, "op12_collocations": op12.ORACLE, "op13_hyper_minhash": op13.ORACLE}
