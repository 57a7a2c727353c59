"""Every registered query of the listing engine against its DuckDB oracle, on the smallest tables."""

import pytest

from keyscape.plans import registry

from .helpers import assert_same, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


def test_each_query_has_an_oracle():
    assert registry.QUERIES.keys() == registry.ORACLES.keys()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    assert_same(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])


def test_entry():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
