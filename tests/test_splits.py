import random

import pytest
from pyspark.sql import functions as F

from dataprobe.operators import splits


def fold(values, alpha=0.35, beta=0.15):
    n = min(len(values), 5)
    level, trend = values[0], (values[n - 1] - values[0]) / (n - 1) if n > 1 else 0.0
    for v in values:
        new = alpha * v + (1 - alpha) * (level + trend)
        level, trend = new, beta * (new - level) + (1 - beta) * trend
    return level, trend, len(values)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_holt_scan_equals_the_fold(spark, batch):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.uniform(-50, 100)) for i in range(5000)]
    rows += [(6000 + i, f"few{i}", float(j)) for i in range(4) for j in range(i + 1)] + [(9000, "none", None), (9001, "a", None)]
    rows = [(n, *r) for n, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "n long, t long, k string, v double").repartition(5)
    want = {}
    for n, t, k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        if v is not None:
            want.setdefault(k, []).append(v)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {r.k: (r.level, r.trend, r.points) for r in splits.holt_scan(df, "v", ["t", "n"], keys=["k"]).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(fold(want[k]), rel=1e-9, abs=1e-9)
        whole = splits.holt_scan(df, "v", ["t", "n"]).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    everything = [r[3] for r in sorted(rows, key=lambda r: (r[1], r[0])) if r[3] is not None]
    assert (whole.level, whole.trend, whole.points) == pytest.approx(fold(everything), rel=1e-9)
    assert splits.holt_scan(df.limit(0), "v", ["t", "n"], keys=["k"]).count() == 0


@pytest.mark.parametrize("rows", [1, 2, 7, 40])
def test_frames_reach_over_splits(spark, rows):
    rng = random.Random(rows)
    data = [(i, float(rng.randrange(100)) if i % 9 else None) for i in range(120)]
    # many splits with few rows each, so a frame may reach over several of them
    spark.conf.set("spark.sql.shuffle.partitions", "25")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(data, "i long, v double").repartition(3)
        add = lambda w: {"s": F.sum("v").over(w.rowsBetween(-(rows - 1), 0)), "n": F.count("*").over(w.rowsBetween(-(rows - 1), 0))}
        out = splits.with_trailing(df, ["i"], rows, add)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in out.select("i", "s", "n").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for i in range(len(data)):
        frame = [v for _, v in data[max(0, i - rows + 1) : i + 1]]
        known = [v for v in frame if v is not None]
        want.append((i, sum(known) if known else None, len(frame)))
    assert got == want
    assert "SinglePartition" not in plan


def test_frames_of_an_empty_table(spark):
    df = spark.createDataFrame([], "i long, v double")
    assert splits.with_trailing(df, ["i"], 3, lambda w: {"s": F.sum("v").over(w.rowsBetween(-2, 0))}).count() == 0
