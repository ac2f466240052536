"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry_point

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert oracle.difference(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
