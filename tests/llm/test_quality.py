"""Quality classifier: held-out accuracy, shrinkage of sparse sites, odd rows."""

import pytest
from pyspark.sql import functions as F

from dataprobe.llm import quality


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    train = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) != 0)
    held = labels.join(train, "doc_id", "left_anti").withColumn("good", (F.col("quality") == 1) & (F.col("toxic") == 0))
    got = quality.classify(docs, train).join(held, "doc_id").select("keep", "good").collect()
    assert len(got) > 60
    assert sum(r.keep == r.good for r in got) / len(got) > 0.93
    assert sum(r.keep for r in got if r.good) / sum(r.good for r in got) > 0.97


def test_sites_shrink(spark):
    rows = [("a", "x", 0.9)] * 400 + [("a", "y", 0.1)] * 400 + [("b", "x", 0.1)] * 400 + [("c", "x", 0.0)]
    got = {(r._host, r._path): r for r in quality.site_priors(spark.createDataFrame(rows, "_host string, _path string, _good double")).collect()}
    assert got["a", "x"]._prior > 0.8 and got["a", "y"]._prior < 0.2 and got["b", "x"]._prior < 0.15
    assert 0.25 < got["c", "x"]._prior < 0.4  # one row moves its site little
    assert abs(got["a", "x"]._overall - sum(r[2] for r in rows) / len(rows)) < 1e-9


def test_odd_rows(spark, tables):
    docs, labels = tables
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "w " * 50000, None, "s", None)], docs.schema)).withColumn("low", F.lit(1)).withColumn("prior", F.lit(1))
    got = quality.classify(odd, labels, model=quality.fit(docs, labels)).collect()
    assert len(got) == 4 and all(0 < r.posterior < 1 for r in got)
    kept = quality.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == 4  # without labels all stay
    assert quality.classify(docs.limit(0), labels).collect() == []
