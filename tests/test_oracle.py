"""Every registered query with an oracle must match DuckDB on sf0.001, and every
query without one must run; both on the whole tables."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck

from paths import SF0001

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], SQL[name], SF0001)
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_oracle(spark, name):
    assert QUERIES[name](spark, SF0001).count() >= 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
