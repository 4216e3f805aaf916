"""Order, quantiles, sources, shapes and statistics on small frames."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dataprobe import scratch
from dataprobe.functions.formatting import format_metric, has_dollar_header
from dataprobe.functions.numeric import pct_change, pearson, sample_skewness, to_number
from dataprobe.operators import aggregates as agg
from dataprobe.operators import ordering, quantiles, series, shape
from dataprobe.operators.joining import dense_calendar
from dataprobe.sources import readers, sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one leading key."""
    rnd = random.Random(1)
    rows = [(7 if i % 3 == 0 else rnd.randint(0, 50), i, float(rnd.choice([0.0, 1.5, 3.25, i / 7]))) for i in range(3000)]
    return frame(spark, rows, "k int, id long, v double").repartition(6)


def test_row_index_is_the_sorted_position(skewed):
    got = ordering.row_index(skewed, ["k", "id"], "pos").toPandas().sort_values("pos")
    assert got["pos"].tolist() == list(range(1, 3001))
    assert got[["k", "id"]].values.tolist() == got.sort_values(["k", "id"])[["k", "id"]].values.tolist()


def test_running_total(skewed):
    got = ordering.running_total(skewed, ["k", "id"], ["id"]).toPandas().sort_values(["k", "id"])
    assert got["upto_id"].tolist() == got["id"].cumsum().tolist()


def test_fill_both_ways_over_splits(spark):
    rows = [(i, None if i % 700 != 350 else f"v{i}") for i in range(3000)]
    df = frame(spark, rows, "id int, c string").repartition(5)
    got = ordering.fill_both_ways(df, ["c"], ["id"]).toPandas().sort_values("id")["c"].tolist()
    want = pd.Series([r[1] for r in rows]).ffill().bfill().tolist()
    assert got == want


@pytest.mark.parametrize("n", [2, 3, 5, 6, 7, 10, 11])
def test_quantile_bin_is_qcut(spark, n):
    df = spark.range(n).select((F.col("id") + 1).alias("p"))
    got = [r[0] for r in df.orderBy("p").select(ordering.quantile_bin(F.col("p"), F.lit(n), min(4, n))).collect()]
    assert got == pd.qcut(pd.Series(range(1, n + 1)), q=min(4, n), labels=False).tolist()


@pytest.mark.parametrize(("inside", "accuracy"), [(20_000, 10_000), (5, 20), (0, 50)])
def test_quantiles_after_any_number_of_steps(skewed, inside, accuracy):
    probs = [0.0, 0.25, 0.5, 0.6, 0.75, 0.999, 1.0]
    got = quantiles.quantile_row(skewed, ["v", "id", "k"], probs, inside=inside, accuracy=accuracy).first()
    pdf = skewed.toPandas()
    for c in ("v", "id", "k"):
        assert got[c] == pytest.approx(pdf[c].quantile(probs).tolist())


def test_quantiles_with_nulls_and_one_value(spark):
    df = frame(spark, [(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert quantiles.quantile_row(df, ["a"], [0.5]).first()["a"] == [2.0]
    assert quantiles.quantile_row(df, ["a", "b"], [0.5]).first()["b"] is None
    assert quantiles.quantile_row(df.limit(0), ["a"], [0.5]).first()["a"] is None


def test_statistics_match_pandas(spark):
    x = [1.0, 2.0, 2.5, 9.0, None, 4.0]
    y = [2.0, None, 1.0, 7.0, 3.0, 5.0]
    df = frame(spark, list(zip(x, y, [1.0] * 6)), "x double, y double, one double")
    r = df.agg(
        sample_skewness("x").alias("s"), pearson("x", "y").alias("r"), pearson("x", "one").alias("c"), sample_skewness("one").alias("s1")
    ).first()
    px, py = pd.Series(x), pd.Series(y)
    assert r["s"] == pytest.approx(px.skew()) and r["r"] == pytest.approx(px.corr(py))
    assert r["c"] is None and r["s1"] is None


def test_numbers_and_change(spark):
    df = frame(spark, [("1.5",), ("x",), (None,), ("NaN",)], "t string")
    assert [r[0] for r in df.select(to_number("t")).collect()] == [1.5, 0.0, 0.0, 0.0]
    one = spark.range(1)
    assert one.select(pct_change(F.lit(0.0), F.lit(0.5))).first()[0] == 50.0
    assert one.select(pct_change(F.lit(-200.0), F.lit(-100.0))).first()[0] == 50.0


def test_modes_and_duplicates(spark):
    df = frame(spark, [("b", 1), ("a", 1), ("a", 1), ("b", 2), (None, 2)], "c string, n int")
    m = {r["column"]: (r["mode"], r["count"]) for r in agg.modes(df, ["c", "n"]).collect()}
    assert m == {"c": ("a", 2), "n": ("1", 3)}
    assert agg.duplicate_count(df).first().asDict() == {"rows": 5, "duplicate_rows": 1}
    assert agg.duplicate_count(df.limit(0)).first().asDict() == {"rows": 0, "duplicate_rows": 0}


def test_distinct_and_missing(spark):
    df = frame(spark, [(1.0, "a"), (float("nan"), None), (1.0, "b")], "x double, s string")
    d = {r["column"]: r["distinct_count"] for r in agg.distinct_counts(df).collect()}
    m = {r["column"]: (r["missing_count"], r["missing_percent"]) for r in agg.missing_counts(df).collect()}
    assert d == {"x": 1, "s": 2} and m == {"x": (1, 33.33), "s": (1, 33.33)}


def test_names():
    assert shape.safe_names([" A b ", "a_b", "A-b!", "$", ""]) == ["a_b", "a_b_2", "ab", "col", "col_2"]
    assert shape.safe_names(["a", "a_2", "a"]) == ["a", "a_2", "a_3"]
    assert has_dollar_header(["Sales ($)"]) and not has_dollar_header(["sales"])


def test_period_tag_and_filter(spark):
    df = frame(spark, [("2024-01-01",), ("2024-02-01",), ("2024-03-01",), ("2024-04-01",)], "d string").select(F.to_date("d").alias("d"))
    tags = [r[0] for r in df.select(shape.tag_period("d", "2024-02-01", "2024-03-01")).collect()]
    assert tags == ["p1", "p2", "p2", None]
    t = frame(spark, [("S", 5, 1.0), ("N", 5, 2.0)], "region string, n int, x double")
    assert shape.filter_equal(t, {"region": "S", "n": "5", "x": "", "zzz": 1}).count() == 1
    assert shape.filter_equal(t, {"x": "2.0"}).count() == 1
    assert shape.filter_equal(t, {"n": "05"}).count() == 0


def test_dates_below_the_gate_stay_null(spark):
    df = frame(spark, [("2024-01-05",), ("x",), ("y",), ("z",)], "d string")
    assert shape.coerce_dates(df, "d", 0.3).filter("d IS NOT NULL").count() == 0
    assert shape.coerce_dates(df, "d", 0.2).filter("d IS NOT NULL").count() == 1


def test_interpolate_and_calendar(spark):
    df = frame(spark, [("2024-01-01", 1.0), ("2024-01-04", 4.0)], "d string, v double").select(F.to_date("d").alias("date"), "v")
    out = series.interpolate(dense_calendar(df, extra_days=2), "v").orderBy("date")
    assert [r["v"] for r in out.collect()] == [1.0, 2.0, 3.0, 4.0, 4.0, 4.0]


def test_metric_text(spark):
    cases = [
        ("revenue", -1234.5, "-1,234.50"), ("churn_rate", 0.256, "25.6%"), ("churn_rate", 25.6, "25.6%"), ("delay_days", 3.0, "3.0 days"),
        ("score", 8.0, "8.0 / 10"), ("quantity", 1200.0, "1,200"), ("quantity", 1.25, "1.25"), ("weight", 2.0, "2.00"),
        ("carrier", 2.0, "2.00"),
    ]
    df = frame(spark, [(a, b) for a, b, _ in cases], "n string, v double")
    assert [r[0] for r in df.select(format_metric(F.col("n"), F.col("v"))).collect()] == [c for _, _, c in cases]
    assert spark.range(1).select(format_metric(F.lit("price"), F.lit(5.0), dollar=True)).first()[0] == "$5.00"


# ---------------------------------------------------------------------- sources

def write(path, data, mode="w", **kw):
    with open(path, mode, **kw) as f:
        f.write(data)
    return str(path)


def test_csv_separators_bad_lines_and_encoding(spark, tmp_path):
    a = write(tmp_path / "a.csv", 'id;name;n\n1;"x;y";2\n2;z;3;9;9\n3;w\n')
    got = [tuple(r) for r in readers.read_csv(spark, a).orderBy("id").collect()]
    assert got == [(1, "x;y", 2), (3, "w", None)]
    b = write(tmp_path / "b.csv", "id\tcity\n1\tKöln\n".encode("latin-1"), "wb")
    assert readers.detect_layout(spark, b) == ("ISO-8859-1", False)
    assert readers.read_csv(spark, b).first()["city"] == "Köln"
    c = write(tmp_path / "c.csv", "﻿id,city\n1,Köln\n".encode("utf-8"), "wb")
    df = readers.read_csv(spark, c)
    assert df.columns == ["id", "city"] and df.first()["city"] == "Köln"
    d = write(tmp_path / "d.csv", "only\n1\n2\n")
    assert readers.read_csv(spark, d).count() == 2


def test_json_array_and_lines(spark, tmp_path):
    a = write(tmp_path / "a.json", '[{"x": 1}, {"x": 2}]')
    b = write(tmp_path / "b.json", '{"x": 1}\n{"x": 2}\n')
    assert readers.read_json(spark, a).count() == readers.read_json(spark, b).count() == 2


def test_dispatch_and_precedence(spark, tmp_path):
    raw = write(tmp_path / "t.csv", "id\n1\n2\n")
    cleaned = str(tmp_path / "clean")
    assert readers.load_dataset(spark, raw, cleaned).count() == 2
    sinks.write_parquet(spark.range(7).toDF("id"), cleaned)
    assert readers.load_dataset(spark, raw, cleaned).count() == 7
    fmt, head = readers.inspect(spark, raw)
    assert fmt == "csv" and head.count() == 2
    with pytest.raises(readers.UnsupportedFormat):
        readers.read_table(spark, "x.xlsx")
    with pytest.raises(ValueError):
        readers.register_view(spark, "a b; drop", raw)


def test_reports_append_per_dataset(spark, tmp_path):
    path = str(tmp_path / "reports")
    for name, n in (("a", 2), ("b", 3), ("a", 4)):
        sinks.append_report(spark.range(n).toDF("score"), path, name)
    assert sinks.read_report(spark, path, "a").count() == 6
    assert sinks.read_report(spark, path).count() == 9


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch, tmp_path):
    class Context:
        master = "spark://host"

    class Conf:
        value = None

        def get(self, key, default=None):
            assert key == "spark.checkpoint.dir"
            return self.value or default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        scratch.scratch_path(Session(), "x")
    Conf.value = "hdfs://shared/dir"
    assert scratch.scratch_path(Session(), "x").startswith("hdfs://shared/dir/")


def test_csv_with_line_breaks_in_fields(spark, tmp_path):
    rows = [(1, 'a\nb "quoted", c'), (2, " plain "), (3, "x\n\ny")]
    df = frame(spark, rows, "id int, t string")
    path = sinks.write_csv(df, str(tmp_path / "broken.csv"))
    assert readers.detect_layout(spark, path) == ("UTF-8", True)
    assert sorted(tuple(r) for r in readers.read_csv(spark, path).collect()) == rows


def test_scope_deletes_what_was_written(spark):
    from pathlib import Path

    from dataprobe.operators import clean, report, rootcause

    rows = [(i, f"2024-01-{1 + i % 28:02d}", "ab"[i % 2], float(i % 9), None if i % 5 == 0 else float(i)) for i in range(200)]
    df = frame(spark, rows, "n int, day string, grp string, v double, w double").withColumn("day", F.to_date("day"))
    folder = Path(scratch.scratch_path(spark, "probe").removeprefix("file:")).parent
    there = lambda: set(folder.glob("dataprobe-*"))
    before = there()
    with scratch.scope(spark):
        assert clean.clean(df, ["n"])[0].count() == 200
        assert rootcause.investigate(df, "v", "day", ["n"])["totals"].count() == 1
        report.executive_report(df, "t", ["n"], target="v", ts="day", with_models=False)["findings"].collect()
        assert there() > before
    assert there() == before
