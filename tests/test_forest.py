"""Forests over cells against MLlib's, on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dataprobe.operators import forest, metrics, models


@pytest.fixture(scope="module")
def rows(spark):
    from dataprobe.scratch import materialise

    r = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    df = spark.range(20_000).select(
        F.col("id").alias("order_id"), r(9, 1).cast("double").alias("a"), F.when(r(20, 2) > 0, r(5, 3).cast("double")).alias("b"),
        F.element_at(F.array(*[F.lit(x) for x in "xyz"]), (r(3, 4) + 1).cast("int")).alias("kind"), (r(1000, 5) / 1000).alias("noise"),
    )
    df = df.withColumn("revenue", F.col("a") * 10 + F.coalesce("b", F.lit(0.0)) * 3 + F.col("noise"))
    return materialise(df.withColumn("flag", ((F.col("a") > 5) | (F.col("noise") > 0.9)).cast("int")).drop("noise"), "forest-rows")


def both(monkeypatch, run):
    """What ``run`` gives with MLlib's trees, then with those over cells, which must have been used."""
    used = []
    whole = forest.fit
    monkeypatch.setattr(forest, "fit", lambda *a, **k: used.append(1) or whole(*a, **k))
    out = []
    for least in (10**9, 1):
        monkeypatch.setattr(forest, "ROWS", least)
        out.append(run())
    assert used == [1]
    return out


def test_numbers(rows, monkeypatch):
    def run():
        drivers, scores = models.target_drivers(rows.drop("kind", "flag"), "revenue", trees=20, depth=4, key=["order_id"])
        return {r["feature"]: r["importance"] for r in drivers.collect()}, {r["scope"]: r["score"] for r in scores.collect()}

    (a, s), (b, t) = both(monkeypatch, run)
    assert a.keys() == b.keys() == {"a", "b"} and all(abs(a[k] - b[k]) < 0.005 for k in a)
    assert s.keys() == t.keys() and all(abs(s[k] - t[k]) < 0.005 for k in s)


def test_classes(rows, monkeypatch):
    def run():
        fit = models.risk_model(rows.drop("revenue"), "flag", ["order_id"], trees=20, depth=4)
        scored = fit.scored.select("order_id", "label", "prediction", "score").collect()
        auc = metrics.roc_auc(fit.scored).first()[0]
        return {r["feature"]: r["importance"] for r in fit.importances().collect()}, {r["order_id"]: (r["label"], r["prediction"], r["score"]) for r in scored}, auc

    (a, s, u), (b, t, v) = both(monkeypatch, run)
    assert max(a, key=a.get) == max(b, key=b.get) == "a" and all(abs(a[k] - b[k]) < 0.1 for k in a)
    assert s.keys() == t.keys() and len(s) == 5001 and np.mean([s[i][:2] == t[i][:2] for i in s]) > 0.99
    assert abs(u - v) < 0.01 and np.mean([abs(s[i][2] - t[i][2]) for i in s]) < 0.05


def test_several_classes(rows, monkeypatch):
    df = rows.select("order_id", "b", "a", F.concat(F.lit("c"), (F.col("a") % 3).cast("int")).alias("target"))

    def run():
        drivers, scores = models.target_drivers(df, "target", trees=20, depth=6, key=["order_id"])
        return {r["scope"]: r["score"] for r in scores.collect()}, drivers.first()["feature"]

    (s, f), (t, g) = both(monkeypatch, run)
    assert f == g == "a" and all(abs(s[k] - t[k]) < 0.05 for k in s) and min(t.values()) > 0.9


def test_draws_are_those_of_a_bootstrap(rows):
    frame = rows.select(F.col("a").alias("x_a"), F.lit(1.0).alias("label"), F.lit(False).alias("held"))
    bins = forest.find_bins(frame, ["a"], 20_000, 32, 1)
    assert bins.shape == (9,)
    sums = forest._number_sums(frame, bins, 50, 1).collect()
    drawn = np.zeros((50, 9))
    for r in sums:
        drawn[r["tree"], np.frombuffer(r["cells"], np.int64)] += np.frombuffer(r["sums"]).reshape(3, -1)[0]
    # Poisson(1) a row: mean and variance of a tree's draws are the number of rows
    assert abs(drawn.sum(axis=1).mean() / 20_000 - 1) < 0.005 and 0.4 < drawn.sum(axis=1).var() / 20_000 < 2.0
    assert abs(forest._poisson_table().mean() - 1) < 1e-3 and abs(forest._poisson_table().astype(float).var() - 1) < 1e-3


def test_many_cells_are_left_to_mllib(rows, monkeypatch):
    monkeypatch.setattr(forest, "ROWS", 1)
    frame = rows.select("order_id", "a", (F.col("order_id") * 1.5).alias("b"), (F.col("order_id") % 977 * 1.0).alias("c"), "revenue")
    monkeypatch.setattr(forest, "fit", lambda *a, **k: pytest.fail("not for cells"))
    drivers, _ = models.target_drivers(frame, "revenue", trees=3, depth=2, key=["order_id"])
    assert drivers.first()["feature"] == "a"


def test_trees_pass_over_the_rows_once(rows, monkeypatch):
    """MLlib passes over all rows once a level and keeps a number of each row and tree; cells need one pass."""
    spark = rows.sparkSession
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    monkeypatch.setattr(models, "materialise", lambda df, label: materialise(df, label).mapInArrow(counted, df.schema) if label == "drivers" else materialise(df, label))
    from dataprobe.scratch import materialise

    monkeypatch.setattr(forest, "ROWS", 1)
    models.target_drivers(rows.drop("kind", "flag"), "revenue", trees=3, depth=6, key=["order_id"])
    # the number of rows, those that intervals are taken from, and the pass over all
    assert read.value <= 3 * 20_000
