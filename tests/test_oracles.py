"""Every catalogue query against its SQL on the smallest tables."""

import pytest
from support import same_rows

from ravel import catalog, oracles

QUERIES = catalog.queries()


def test_every_oracle_has_its_query():
    assert set(oracles.ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(oracles.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracles.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0
