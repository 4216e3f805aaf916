import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from dataprobe.operators import models, selection, shape


def order(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("seed", range(2))
def test_keys_at_ranks_by_narrowing(spark, seed):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = [(rng.choice([None, "a", "hot", "hot", "hot", "ü"]), rng.choice([None, base, base + dt.timedelta(days=rng.randrange(5))]), i) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, t timestamp_ntz, n long").repartition(5)
    want = sorted(rows, key=order)
    for rank in (1, 777, 2999):
        key = selection.keys_at(df, ["s", "t", "n"], {None: (rank, 3000)}, sample=300).first()["_key"]
        assert (key["v0"], key["v1"], key["v2"]) == want[rank - 1]
        got = selection.first_rows(df, ["s", "t", "n"], rank, 3000, sample=300).filter("_first").collect()
        assert sorted((tuple(r)[:3] for r in got), key=order) == want[:rank]


def test_many_equal_keys_end(spark):
    df = spark.createDataFrame([(1,)] * 500 + [(2,)] * 3, "n long")
    assert selection.keys_at(df, ["n"], {None: (250, 503)}, sample=50).first()["_key"]["v0"] == 1
    assert selection.keys_at(df, ["n"], {None: (502, 503)}, sample=50).first()["_key"]["v0"] == 2


def test_groups_of_unequal_size(spark):
    rows = [(i, "big" if i % 50 else "small", i % 7) for i in range(4000)] + [(5000, None, 1)]
    df = spark.createDataFrame(rows, "n long, label string, v int")
    got = selection.first_rows_of_groups(df, "label", ["v", "n"], 0.25, sample=300).filter("_first").collect()
    want = []
    for label in ("big", "small", None):
        mine = sorted((r for r in rows if r[1] == label), key=lambda r: (r[2], r[0]))
        want += mine[: math.ceil(len(mine) * 0.25)]
    assert sorted((r.n for r in got)) == sorted(r[0] for r in want)


def test_flags_need_no_exchange_of_rows(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("label"), F.hash("id").alias("h"))
    for out in (shape.split_by_position(df, ["h", "id"]), models.stratified_split(df, "label", ["id"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "SinglePartition" not in plan
    assert shape.split_by_position(df, ["h", "id"]).filter("period = 'p1'").count() == 2750
    assert shape.split_by_position(df.limit(0), ["h", "id"]).count() == 0
    assert models.stratified_split(df.limit(0), "label", ["id"]).count() == 0
    assert shape.split_by_position(df.limit(1), ["h", "id"]).first()["period"] == "p1"
