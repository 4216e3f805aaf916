"""Range joins, clusters without a seed and best cuts, beside plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dataprobe.operators import rfm
from dataprobe.operators.intervals import range_join
from dataprobe.operators.splitgains import split_gains


def test_range_join_meets_every_pair(spark):
    rng = random.Random(5)
    points = [(i, round(rng.choice([rng.uniform(-50, 50), 7.0, rng.uniform(-1e6, 1e6)]), 3)) for i in range(400)]
    points += [(900, None), (901, math.nan), (902, math.inf), (903, -math.inf)]
    ranges = []
    for j in range(120):
        lo = round(rng.choice([rng.uniform(-60, 60), 7.0, rng.uniform(-1e6, 1e6)]), 3)
        ranges.append((j, lo, lo + rng.choice([0.0, -3.0, 1e-3, 0.5, 8.0, 64.0, 2e6])))
    ranges += [(200, -math.inf, math.inf), (201, None, 3.0), (202, 3.0, None), (203, math.nan, 3.0), (204, 0.0, math.nan), (205, -math.inf, 7.0), (206, 7.0, math.inf), (207, 2e7, 3e7)]
    p, r = spark.createDataFrame(points, "i long, x double"), spark.createDataFrame(ranges, "j long, lo double, hi double")
    known = [(i, x) for i, x in points if x is not None and math.isfinite(x)]
    want = {(i, j) for i, x in known for j, lo, hi in ranges if lo is not None and hi is not None and lo <= x < hi}
    for depth in (20, 3):
        got = range_join(p, "x", r, "lo", "hi", depth=depth)
        rows = [(x.i, x.j) for x in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        assert got.columns == ["i", "x", "j", "lo", "hi"]
    plan = got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_range_join_without_rows(spark):
    p, r = spark.createDataFrame([(1, 2.0)], "i long, x double"), spark.createDataFrame([(1, 0.0, 2.0)], "j long, lo double, hi double")
    assert range_join(p.filter("false"), "x", r, "lo", "hi").count() == 0
    assert range_join(p, "x", r.filter("false"), "lo", "hi").count() == 0
    assert range_join(p, "x", r, "lo", "hi").count() == 0  # the end does not belong to the range
    assert range_join(p, "x", r.withColumn("hi", F.lit(2.5)), "lo", "hi").count() == 1
    with pytest.raises(ValueError):
        range_join(p, "x", r.withColumnRenamed("j", "i"), "lo", "hi")


def test_range_totals_build_no_pairs(spark):
    rng = random.Random(6)
    points = [(i, rng.choice([round(rng.uniform(-50, 50), 1), 7.0, 0.0, -0.0, rng.uniform(-1e6, 1e6), 1e300])) for i in range(500)]
    points += [(900, None), (901, math.nan), (902, math.inf), (903, -math.inf), (None, 7.0)]
    ranges = []
    for j in range(150):
        lo = rng.choice([round(rng.uniform(-60, 60), 1), 7.0, 0.0, -0.0, rng.uniform(-1e6, 1e6)])
        ranges.append((j, lo, lo + rng.choice([0.0, -3.0, 1e-3, 0.5, 8.0, 64.0, 2e6])))
    ranges += [(200, -math.inf, math.inf), (201, None, 3.0), (202, 3.0, None), (203, math.nan, 3.0), (204, 0.0, math.nan), (205, -math.inf, 7.0), (206, 7.0, math.inf), (207, 7.0, math.inf), (207, 7.0, math.inf)]
    p, r = spark.createDataFrame(points, "i long, x double"), spark.createDataFrame(ranges, "j long, lo double, hi double")
    known = [(i, x) for i, x in points if x is not None and math.isfinite(x)]
    want = []
    for j, lo, hi in ranges:
        held = [i for i, x in known if lo is not None and hi is not None and lo <= x < hi]
        if held:
            want.append((j, len(held), min([i for i in held if i is not None], default=None)))
    got = range_join(p, "x", r, "lo", "hi", least={"first": "i"})
    assert got.columns == ["j", "lo", "hi", "n", "first"]
    assert sorted((x.j, x.n, x.first) for x in got.collect()) == sorted(want)
    for a, b in ((p.filter("false"), r), (p, r.filter("false"))):
        assert range_join(a, "x", b, "lo", "hi", least={}).count() == 0
    # 4,000 wide ranges over 4,000 points: no step makes the 16 million pairs
    wide = range_join(spark.range(4000).selectExpr("id AS i", "id * 1.5 AS x"), "x", spark.range(4000).selectExpr("id AS j", "-1.0 AS lo", "id + 6000.0 AS hi"), "lo", "hi", least={"first": "i"})
    assert wide.filter("n = 4000 and first = 0").count() == 4000
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and " < _hi" not in plan


def plain_gain(pairs):
    pairs = sorted(pairs)
    total = lambda ys: sum((y - sum(ys) / len(ys)) ** 2 for y in ys)
    all_y = [y for _, y in pairs]
    best = None
    for v in sorted({x for x, _ in pairs})[:-1]:
        left, right = [y for x, y in pairs if x <= v], [y for x, y in pairs if x > v]
        gain = round(1 - (total(left) + total(right)) / total(all_y), 9)
        if best is None or gain > best[1]:
            best = (v, gain, len(left))
    return best


def test_split_gains_of_every_cut(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(500):
        a, b = rng.choice([None, *range(8)]), rng.choice([math.nan, rng.random()])
        rows.append((a, b, 1, rng.choice([None, float((a or 0) > 4) + rng.random() / 9 + 1e6])))
    df = spark.createDataFrame(rows, "a int, b double, same int, y double")
    got = {r.feature: r for r in split_gains(df, F.col("y"), ["a", "b", "same"], digits=6).collect()}
    assert set(got) == {"a", "b"}
    for i, name in enumerate(("a", "b")):
        v, gain, n = plain_gain([(float(r[i]), r[3]) for r in rows if r[3] is not None and r[i] is not None and not math.isnan(r[i])])
        assert got[name].threshold == v and got[name].n_below == n and abs(got[name].gain - gain) < 2e-6
    assert got["a"].threshold == 4 and got["a"].mean_above - got["a"].mean_below > 0.9
    assert split_gains(df.filter("false"), F.col("y"), ["a"]).count() == 0
    assert split_gains(df.withColumn("y", F.lit(3)), F.col("y"), ["a", "b"]).count() == 0


def test_clusters_are_found_and_named(spark):
    centres = [(2, 40, 9000.0), (3, 20, 5000.0), (300, 2, 90.0), (20, 4, 300.0)]
    rows = [(i, centres[i % 4][0] + i % 3, centres[i % 4][1] + i % 2, centres[i % 4][2] + i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "entity int, recency int, frequency int, monetary double")
    got = rfm.rfm_clusters(df).collect()
    names = {i: {r.segment for r in got if r.entity % 4 == i} for i in range(4)}
    assert names == {0: {"Champions"}, 1: {"Loyal Customers"}, 2: {"At Risk"}, 3: {"Potential Loyalists"}}
    again = rfm.rfm_clusters(df.repartition(7)).collect()
    assert {(r.entity, r.cluster) for r in got} == {(r.entity, r.cluster) for r in again}
    # fewer different entities than clusters, one, none, and no value
    assert rfm.rfm_clusters(df.filter("entity in (0, 1, 60, 61)").withColumns({"recency": F.lit(1), "frequency": F.lit(2), "monetary": F.col("entity") % 2 * 1.0})).select("cluster").distinct().count() == 2
    assert rfm.rfm_clusters(df.filter("entity = 3")).count() == 1
    assert rfm.rfm_clusters(df.filter("false")).count() == 0
    assert rfm.rfm_clusters(df.withColumn("monetary", F.lit(None).cast("double"))).count() == 0
