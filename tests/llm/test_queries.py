"""Whole queries: against SQL where there is SQL, and on empty and odd tables."""

import pytest
from support import same_rows

from ravel.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    same_rows(Q.queries()[name](spark, sf_dir).toPandas(), duck.execute(Q.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_on_empty_and_odd_tables(spark, tables, name):
    f = Q.queries()[name]
    assert f(spark, tables["none"]).count() == 0
    rows = f(spark, tables["full"]).collect()
    if name in ("op11_spelling_variants", "op12_collocations"):  # rows are words and phrases
        return
    assert len(rows) >= 16
    if name not in ("op8_best_fit_packing",):
        assert len(rows) == 16


def test_there_is_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in Q.queries()) == list(range(1, 14))
