"""Each core query with SQL gives what DuckDB gives on the smallest tables."""

import pytest
from conftest import DATA, check_query

from skyframe.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    check_query(spark, duck, QUERIES[name], SQL[name])


def test_every_sql_has_a_query():
    assert not set(SQL) - set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
