"""Every registered note query against its SQL on the smallest tables."""

import pytest

from quaero.plans import registry

from .conftest import SMALL, same_as_sql

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same_as_sql(registry.queries()[name](spark, SMALL), SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_other_queries_have_rows(spark, name):
    assert not registry.queries()[name](spark, SMALL).isEmpty()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
