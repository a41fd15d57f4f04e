"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import compare
from helixframe import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    same, what = compare.compare(spark, con, QUERIES[key], SQL.get(key), SF)
    assert same, what


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
