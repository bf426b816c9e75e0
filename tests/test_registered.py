"""Every registered query against its checking SQL on the small tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import difference, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duck(SF)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert difference(df, con, ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_every_check_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 6
