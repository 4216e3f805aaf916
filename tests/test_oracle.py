"""Every registered query beside its SQL on the smallest tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_oracle  # noqa: E402

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return check_oracle.connect(sf_dir)


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "value", "count"] and df.count() == 10


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, sf_dir, name):
    problems, _, _ = check_oracle.compare(spark, con, name, QUERIES[name], SQL[name], sf_dir)
    # small tables may leave a filter without rows
    assert [p for p in problems if p != "empty result"] == []
