"""The corpus pipeline: STAGES in order, each over the documents that the one before it kept.

Documents that the quality rules reject go; repeated chunks of lines leave the texts; one document of each near-duplicate class stays; documents
with benchmark passages go; the rest is packed. All stages but the last return the columns of documents.

Defined cases: null and empty texts fail the quality rules' least number of words; a very long text is one row in every stage and is cut by the packing alone; of ties and repeated rows
one stays (near duplicates: that of the least doc_id, null last); an empty table gives empty tables; other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravel.llm import decontaminate, line_chunks, near_join, packing, quality_rules
from ravel.llm.common import cut, read, text_and_id


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_text(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"), decontaminate.DecontaminationOptions(unnamed=True))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(text_and_id(docs))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: SQL has neither the n-gram likelihood ratio nor the tokenizer; tests compare its stages with plain versions of what they keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{i}-{name}")
    return docs
