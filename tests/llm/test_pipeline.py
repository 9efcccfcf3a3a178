"""The pipeline's stages against plain versions of what they keep."""

from llm_support import plain_groups
from pyspark.sql import functions as F

import corpus_pipeline as P
from ravel.llm import decontaminate, quality_rules
from ravel.llm.common import cut, read


def test_stages_are_the_named_ones():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]


def test_each_stage_on_its_own_input(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns = docs.columns
    stage = dict(P.STAGES)
    one = cut(stage["quality_rules"](spark, docs, sf_dir), "t")
    kept = quality_rules.quality_rules(docs, quality_rules.trusted_ids(read(spark, sf_dir, "labels"))).filter("quality_rules.kept").select("doc_id")
    assert one.columns == columns and {r.doc_id for r in one.select("doc_id").collect()} == {r.doc_id for r in kept.collect()}
    two = cut(stage["line_dedup"](spark, one, sf_dir), "t")
    assert two.columns == columns and two.count() == one.count()
    assert two.filter(F.length("text") != F.col("n_chars")).count() == 0
    three = cut(stage["ngram_jaccard_join"](spark, two, sf_dir), "t")
    rows = sorted((r.doc_id, r.text) for r in two.collect())
    groups, _ = plain_groups([t for _, t in rows])
    first = {}
    for (i, _), g in zip(rows, groups):
        first.setdefault(g, i)
    assert three.columns == columns and sorted(r.doc_id for r in three.collect()) == sorted(first.values())
    four = cut(stage["benchmark_decontamination"](spark, three, sf_dir), "t")
    hit = decontaminate.find(three, read(spark, sf_dir, "benchmark")).filter("decontamination.n_hit > 0").count()
    assert four.columns == columns and four.count() == three.count() - hit
    five = stage["best_fit_packing"](spark, four, sf_dir)
    assert {r.doc_id for r in five.select("doc_id").distinct().collect()} == {r.doc_id for r in four.select("doc_id").collect()}


def test_run_equals_its_stages_and_takes_odd_tables(spark, tables):
    docs = read(spark, tables["full"], "documents")
    for _, f in P.STAGES:
        docs = cut(f(spark, docs, tables["full"]), "t")
    a = sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in docs.collect())
    b = sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in P.run(spark, tables["full"]).collect())
    assert a == b
    assert P.run(spark, tables["none"]).count() == 0


def test_stages_keep_clashing_columns(spark, tables, clashing):
    docs = clashing
    for name, f in P.STAGES[:-1]:
        docs = f(spark, docs, tables["full"])
        assert docs.columns == clashing.columns, name
    assert P.STAGES[-1][1](spark, docs, tables["full"]).count() >= 0
