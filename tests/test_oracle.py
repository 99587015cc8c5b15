"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck
from tillroll.plans.registry import QUERIES

KEYS = list(QUERIES)


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


def test_every_key_has_sql():
    assert set(KEYS) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(spark, con, small_dir, key):
    got = E.queries()[key](spark, small_dir).toPandas()
    want = con.sql(E.oracle_sql()[key]).df()
    ok, msg = compare(got, want)
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["year_month", "revenue"]
    assert df.count() > 0
