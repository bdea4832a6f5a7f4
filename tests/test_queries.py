"""Every registered query against its SQL, or for rows and columns without SQL."""

import pytest

import __spark_entry__ as entry
from tests.check import compare

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, folder, name):
    ok, note = compare(QUERIES[name](spark, folder), folder, ORACLE[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_runs(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.columns and df.count() > 0


def test_every_oracle_has_a_query():
    assert not ORACLE.keys() - QUERIES.keys()


def test_entry(spark):
    assert entry.entry(spark).count() == 1
