"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from sievework.registered import load_all
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("key", sorted(load_all()[0]))
def test_query(key, spark, sf_dir, con):
    df = entry.queries()[key](spark, sf_dir)
    sql = entry.oracle_sql().get(key)
    assert sql is not None, "every query has its SQL"
    assert compare(df, con, sql) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 10
    assert "failures" in df.columns
