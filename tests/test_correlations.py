"""Correlations from moments of whole batches against pandas."""

import math

import numpy as np
import pandas as pd

from dataprobe.operators import eda


def _table(rows, cols, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(rows, 4))
    x = base @ rng.normal(size=(4, cols)) + rng.normal(size=(rows, cols)) + 1e6  # far from zero
    x[rng.random(x.shape) < 0.1] = np.nan
    return pd.DataFrame(x, columns=[f"v{i}" for i in range(cols)])


def test_many_columns_with_gaps(spark):
    df = _table(600, 200)
    rows = [tuple(None if math.isnan(v) else v for v in r) for r in df.itertuples(index=False)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in df.columns)).repartition(7)
    want = df.corr()
    got = eda.correlation_pairs(table).collect()
    assert len(got) == 200 * 201 // 2
    assert max(abs(r.r - want.loc[r.x, r.y]) for r in got) < 1e-6


def test_rows_are_not_spread_over_pairs(spark):
    plan = eda.correlation_pairs(spark.range(100).selectExpr("id * 2.0D as a", "id * id * 1.0D as b"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1.0, 2.0, 0.1, None, inf, 3.0), (2.0, 4.0, 0.1, None, 1.0, None), (3.0, 6.0, 0.1, None, 2.0, 3.0), (4.0, nan, 0.1, None, 4.0, 3.0), (None, 1.0, 0.1, None, nan, 9.0)]
    df = spark.createDataFrame(rows, "a double, b double, same double, empty double, e double, held double")
    got = {(r.x, r.y): r.r for r in eda.correlation_pairs(df).collect()}
    assert abs(got["a", "b"] - 1) < 1e-12 and abs(got["a", "a"] - 1) < 1e-12
    assert abs(got["a", "e"] - np.corrcoef([2, 3, 4], [1, 2, 4])[0, 1]) < 1e-12
    # a constant, a column without values, and one that is constant wherever the other is known
    assert not any("same" in p or "empty" in p for p in got) and ("a", "held") not in got and ("held", "held") in got


def test_no_rows_and_no_columns(spark):
    assert eda.correlation_pairs(spark.createDataFrame([], "a double, b double")).collect() == []
    assert eda.correlation_pairs(spark.createDataFrame([("x",)], "t string")).collect() == []
