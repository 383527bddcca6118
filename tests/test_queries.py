"""Every registered query against its SQL on whole tables."""

import pytest

import __spark_entry__ as entry
from answerloom.plans.catalog import QUERIES as CATALOG
from compare import difference, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = CATALOG, entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(spark, con, SF, QUERIES[name], SQL[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 1
