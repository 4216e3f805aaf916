"""Classes of a target, tables of two threads, profiles by sketch."""

import os
import threading

import pytest

from dataprobe.operators import clean, models, quality
from dataprobe.scratch import scope, scratch_path


def test_too_many_classes_are_an_error(spark):
    df = spark.createDataFrame([(f"text {i}",) for i in range(30)] + [(None,)], "t string")
    assert len(models.class_levels(df, "t")) == len(models.class_levels(df, "t", 30)) == 30
    with pytest.raises(ValueError, match="more than 29 classes"):
        models.class_levels(df, "t", 29)


def test_a_scope_holds_its_own_threads_tables(spark, tmp_path):
    inside, outside = [], []

    def other():
        outside.append(scratch_path(spark, "other"))
        os.makedirs(outside[0])

    with scope(spark):
        inside.append(scratch_path(spark, "own"))
        os.makedirs(inside[0])
        t = threading.Thread(target=other)
        t.start()
        t.join()
    assert not os.path.exists(inside[0]) and os.path.exists(outside[0])


def test_sketched_profiles_reach_the_callers(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i % 7), "same") for i in range(300)], "key int, kind string, x double, one string")
    assert quality.quality_report(df, exact=False).collect() == quality.quality_report(df).collect()
    a, b = clean.clean(df, ["key"])[0], clean.clean(df, ["key"], exact=False)[0]
    assert sorted(a.collect()) == sorted(b.collect())
