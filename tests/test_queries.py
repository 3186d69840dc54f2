"""Every query against its SQL on the smallest tables."""

import pytest
from compare import difference, duck

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    assert difference(queries()[name](spark, SF_DIR), tables, oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() == 150


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
