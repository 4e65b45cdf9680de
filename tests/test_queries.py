"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import check, duck

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert check(spark, con, SF_DIR, QUERIES[name], ORACLE[name]) is None


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
