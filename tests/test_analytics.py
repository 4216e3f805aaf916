"""Profiles, cleaning, series, segments, models, root cause, questions on small or planted data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dataprobe.operators import ask, charts, clean, eda, iforest, intent, kpi, metrics, models, quality, report, retrieval, rfm, roles, rootcause, sqlsurface
from dataprobe.operators import timeseries as ts
from dataprobe.operators.dashboard import dashboard
from dataprobe.operators.profile import best_target, profile
from dataprobe.plans.inputs import events_dirty, sales_planted


@pytest.fixture(scope="module")
def shop(spark):
    """Orders of 120 days; in days 60..100 the South loses most of its revenue and complains."""
    i = F.col("id")
    day = (i % 120).cast("int")
    region = F.element_at(F.array(*[F.lit(r) for r in ("North", "South", "East", "West")]), ((F.floor(i / 120) % 4) + 1).cast("int"))
    bad = (region == "South") & day.between(60, 100)
    return spark.range(4800).select(
        F.concat(F.lit("ORD-"), i).alias("order_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), day).alias("order_date"),
        F.concat(F.lit("CUST-"), i % 97).alias("customer_id"),
        region.alias("region"),
        F.element_at(F.array(F.lit("Electronics"), F.lit("Furniture")), (i % 2 + 1).cast("int")).alias("product_category"),
        (i % 3 + 1).cast("int").alias("quantity"),
        F.when(bad, 10.0).otherwise(100.0 + (i % 37) / 10).alias("revenue"),
        F.when(bad, 8.0).otherwise(1.5).alias("delivery_delay_days"),
        bad.cast("int").alias("customer_complaint"),
    )


# ------------------------------------------------------------ profile, quality

def test_types(spark):
    df = spark.createDataFrame(
        [(1, 0, "2024-01-01", "a", 1.0, 1.5, "1", None, "u1", [1]), (2, 1, "2024-01-02", "b", 2.0, 2.5, "0", None, "u2", [2])],
        "n int, flag int, d string, cat string, whole double, frac double, b string, none string, user_code string, arr array<int>",
    )
    got = {r["column_name"]: r["detected_type"] for r in profile(df).collect()}
    assert got == {
        "n": "integer", "flag": "boolean", "d": "datetime", "cat": "categorical", "whole": "integer", "frac": "float", "b": "boolean",
        "none": "text", "user_code": "id", "arr": "text",
    }


def test_approximate_profile_has_the_same_shape(spark, shop):
    exact, rough = profile(shop), profile(shop, exact=False)
    assert exact.columns == rough.columns and rough.count() == 9
    a = {r["column_name"]: r["distinct_count"] for r in exact.collect()}
    for r in rough.collect():
        assert r["distinct_count"] == pytest.approx(a[r["column_name"]], rel=0.15)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert [r["detected_type"] for r in profile(df).collect()] == ["text", "text"]
    assert quality.quality_report(df).first()["quality_score"] == 100


def test_target(shop):
    assert best_target(profile(shop)) == "revenue"


def test_quality_of_a_clean_table(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    r = quality.quality_report(df).first()
    assert (r["quality_score"], r["duplicate_rows"], r["missing_cells"]) == (100, 0, 0)


def test_few_rows_have_no_outliers(spark):
    df = spark.createDataFrame([(1.0,), (1.1,), (500.0,)], "v double")
    assert quality.outlier_counts(df, ["v"]).first()["outliers"] == 0


def test_cleaning_leaves_no_gaps(spark, sf_dir):
    out, rep = clean.clean(events_dirty(spark, sf_dir), ["event_id"])
    r = rep.first()
    assert r["duplicates_removed"] == r["original_rows"] - r["processed_rows"] > 0
    gaps = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in out.columns]).first().asDict()
    assert set(gaps.values()) == {0}


def test_cleaning_steps_are_optional(spark, sf_dir, tmp_path):
    d = events_dirty(spark, sf_dir)
    out, rep = clean.clean(
        d, ["event_id"], remove_duplicates=False, impute_missing=False, mark_outliers=False, output=str(tmp_path / "clean")
    )
    assert out.count() == d.count() and rep.first()["outliers_flagged"] == 0
    assert spark.read.parquet(str(tmp_path / "clean")).count() == d.count()


def test_histogram_like_numpy(spark):
    x = np.random.default_rng(3).gamma(2.0, 10.0, 500).round(2)
    df = spark.createDataFrame([(float(v), 5.0) for v in x], "x double, c double")
    got = {(r["column"], r["bin"]): r["count"] for r in eda.histogram(df).collect()}
    assert [got[("x", i)] for i in range(10)] == np.histogram(x, bins=10)[0].tolist()
    assert [got[("c", i)] for i in range(10)] == np.histogram(np.full(500, 5.0), bins=10)[0].tolist()


def test_correlation_like_pandas(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, None, 5], "b": [2.0, 1, None, 4, 9], "c": [1.0] * 5})
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)], "a double, b double, c double")
    got = {(r["x"], r["y"]): r["correlation"] for r in eda.correlations(df).collect()}
    assert got == {("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): round(pdf["a"].corr(pdf["b"]), 2), ("b", "a"): round(pdf["a"].corr(pdf["b"]), 2)}


# ------------------------------------------------------------------ dashboards

def test_six_charts_before_and_after_filtering(shop):
    from dataprobe.operators.shape import filter_equal

    assert len(charts.automatic(shop, ["order_id"])) == 6
    south = filter_equal(shop, {"region": "South"})
    assert 0 < south.count() < shop.count()
    assert len(charts.automatic(south, ["order_id"])) == 6


def test_dashboard_parts(shop):
    parts = dashboard(shop, ["order_date", "order_id"], {"region": "South"}, "order_date")
    assert parts["row_count"].first()[0] == 1200
    assert {r["option"] for r in parts["options"].filter("column = 'region'").collect()} == {"North", "South", "East", "West"}
    assert [r["kpi"] for r in parts["kpis"].collect()] == ["total_records", "primary_monetary", "critical_risk"]
    assert [r["level"] for r in parts["alerts"].collect()].count("danger") == 1
    assert sum(k.startswith("chart_") for k in parts) == 6


def test_a_table_without_columns_is_off_topic(spark):
    q = spark.createDataFrame([("tell me a joke",), ("show totals",)], "question string")
    r = intent.intents(q, intent.Catalogue([])).collect()
    assert [x["off_topic"] for x in r] == [True, False] and r[0]["metric"] is None and r[0]["aggregation"] == "count"


def test_chart_roles(shop):
    r = roles.chart_roles(shop)
    assert (r["metric"], r["dimension"], r["risk"], r["date"]) == ("revenue", "region", "delivery_delay_days", "order_date")
    assert roles.rfm_roles(shop) == {"entity": "customer_id", "date": "order_date", "value": "revenue"}
    assert roles.domain_of(shop) == "ecommerce" and roles.risk_source(shop) == "customer_complaint"


def test_kpis_without_dates_have_no_change(shop):
    rows = kpi.kpi_table_by_role(shop, None).collect()
    assert [r["kpi"] for r in rows] == ["total_records", "primary_monetary", "critical_risk"]
    assert all(r["delta_percent"] is None and r["is_positive"] for r in rows)


# ---------------------------------------------------------------------- series

def _daily(spark, values):
    start = pd.Timestamp("2024-01-01")
    rows = [((start + pd.Timedelta(days=i)).date(), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, value double")


def _holt(v):
    level, trend = v[0], float(np.mean(np.diff(v[:5]))) if len(v) > 1 else 0.0
    for x in v:
        last, level = level, 0.35 * x + 0.65 * (level + trend)
        trend = 0.15 * (level - last) + 0.85 * trend
    return level, trend


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 40])
def test_holt_like_a_loop(spark, n):
    v = np.random.default_rng(n).normal(100, 20, n)
    r = ts.holt_state(_daily(spark, v)).first()
    assert (r["level"], r["trend"]) == pytest.approx(_holt(v))


def test_forecast_of_a_constant_series(spark):
    f = ts.forecast(_daily(spark, [100.0] * 20), 3).orderBy("h").collect()
    assert [r["predicted"] for r in f] == [100.0] * 3
    assert f[0]["upper_bound"] == pytest.approx(100 + 1.96 * 8.0)


def test_forecast_never_below_zero(spark):
    f = ts.forecast(_daily(spark, np.linspace(100, 1, 30)), 60).collect()
    assert min(r["predicted"] for r in f) == 0.0 and min(r["lower_bound"] for r in f) == 0.0


def test_densify_only_short_series(spark):
    short = _daily(spark, [1.0, 2.0, 3.0])
    assert ts.densify(short).count() == 3 + 11
    assert ts.densify(_daily(spark, range(20))).count() == 20


def test_band_needs_prior_days(spark):
    v = [100.0 + (i % 3) for i in range(30)]
    v[20] = 500.0
    d = _daily(spark, v).withColumnRenamed("value", "sum_val").withColumn("count", F.lit(1))
    hit = [str(r["date"]) for r in ts.anomaly_band(d).filter("is_outside").collect()]
    assert hit == ["2024-01-21"]
    assert ts.anomaly_band(d, include_current=True).filter("is_outside").count() == 0
    rec = ts.anomaly_records(ts.anomaly_band(d), "net_sales").first()
    assert rec["severity"] == "Critical" and rec["direction"] == "Spike" and rec["explanation"].startswith("Net Sales had an unusual surge")


def test_forest_finds_the_planted_point_and_repeats(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (400, 2)))]
    rows[123] = (123, 12.0, -11.0)
    df = spark.createDataFrame(rows, "id int, a double, b double")
    one = iforest.isolate(df, ["a", "b"], ["id"]).orderBy(F.col("score").desc()).collect()
    two = iforest.isolate(df.repartition(7), ["a", "b"], ["id"]).orderBy(F.col("score").desc()).collect()
    assert one[0]["id"] == 123 and one[0]["score"] > 0.7
    assert sum(r["is_isolated"] for r in one) == 16
    assert [r["id"] for r in one[:20]] == [r["id"] for r in two[:20]]
    assert [r["score"] for r in one[:20]] == pytest.approx([r["score"] for r in two[:20]])


def test_forest_subsamples_are_bounded(spark):
    df = spark.range(20000).select("id", (F.col("id") % 100).alias("a"))
    picked = iforest.subsamples(df, ["a"], ["id"], 20000, 10, 256, 1).groupBy("tree").count().collect()
    assert len(picked) == 10 and {r["count"] for r in picked} == {256}


# -------------------------------------------------------------------- segments

def test_rfm_without_dates_uses_means(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 30.0), ("b", 5.0), (None, 9.0)], "e string, v double")
    got = {r["entity"]: (r["recency"], r["frequency"], r["monetary"]) for r in rfm.rfm_base(df, "e", None, "v").collect()}
    assert got == {"a": (None, 2, 20.0), "b": (None, 1, 5.0)}


def test_rfm_few_entities_keep_empty_tiers(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 5.0)], "e string, v double")
    seg = rfm.rfm_segments(rfm.rfm_scores(rfm.rfm_base(df, "e", None, "v"))).orderBy("place").collect()
    assert [r["entities"] for r in seg] == [1, 0, 0, 1]


def test_kmeans_names_by_value(spark, sf_dir):
    r = {x["segment"]: x for x in entry.queries()["rfm_kmeans"](spark, sf_dir).collect()}
    assert set(r) == set(rfm.CLUSTER_NAMES)
    assert r["Champions"]["avg_monetary"] == max(x["avg_monetary"] for x in r.values())
    assert r["At Risk"]["avg_recency"] >= r["Potential Loyalists"]["avg_recency"]


# ---------------------------------------------------------------------- models

def test_labels(spark):
    df = spark.createDataFrame([("Yes", i) for i in range(3)] + [("No", i) for i in range(7)], "churn string, v int")
    lab = models.binary_label(df, "churn")
    assert df.agg(F.sum(lab.expr)).first()[0] == 3
    assert models.has_variation(df.select(lab.expr.alias("label")))
    assert not models.has_variation(df.select(F.lit(1).alias("label")))
    assert models.is_classification(df, "churn") and models.is_classification(df, "v")
    assert not models.is_classification(spark.range(50), "id")


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1), (1, 0.1)], "label int, score double")
    # pairs won: 0.5 + 1, 0 + 1, 0 + 0.5 of 6
    assert metrics.roc_auc(df).first()[0] == 0.5
    assert metrics.roc_auc(df.filter("label = 1")).first()[0] is None


def test_metrics_undefined_are_zero(spark):
    r = metrics.binary_metrics(spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (100.0, 0.0, 0.0, 0.0)


def test_split_is_exact_and_repeats(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    a = models.stratified_split(df, "y", ["id"], 0.25)
    n = {(r["y"], r["is_test"]): r["count"] for r in a.groupBy("y", "is_test").count().collect()}
    assert n[(1, True)] == 84 and n[(0, True)] == 167 and sum(n.values()) == 1000
    b = models.stratified_split(df.repartition(3), "y", ["id"], 0.25)
    ids = lambda d: {r["id"] for r in d.filter("is_test").collect()}
    assert ids(a) == ids(b)


def test_risk_model_learns_a_planted_signal(spark, sf_dir):
    m = entry.queries()["churn_model_metrics"](spark, sf_dir).first()
    assert m["roc_auc"] > 0.9 and m["accuracy"] > 80


def test_driver_importances(spark, shop):
    drivers, scores = models.target_drivers(shop, "revenue", trees=10, key=["order_id"])
    rows = drivers.collect()
    assert rows[0]["feature"] in ("customer_complaint", "delivery_delay_days") and rows[0]["direction"].startswith("Negative")
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0, abs=0.05)
    assert {r["scope"]: r["score"] for r in scores.collect()}["held out"] > 0.8


def test_classifier_reports_true_scores(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("target"), F.xxhash64("id").cast("double").alias("noise"))
    score, _ = rootcause.classifier(df, "target", trees=5, depth=2)
    assert score.first()["accuracy"] < 80  # noise must not look like 88


# ------------------------------------------------------------------ root cause

def test_planted_region_is_named(shop):
    parts = rootcause.investigate(shop, "revenue", "order_date", ["order_date", "order_id"], "2024-03-01", "2024-04-10")
    top = parts["top_driver"].first()
    assert (top["dimension"], top["item"]) == ("region", "South") and top["delta"] < 0
    moved = {r["metric"]: r["direction"] for r in parts["shifts"].collect()}
    assert moved["delivery_delay_days"] == "Increased"
    assert "South" in parts["narrative"].first()["why_it_happened"]


def test_planted_asia(spark, sf_dir):
    parts = rootcause.investigate(
        sales_planted(spark, sf_dir), "revenue", "order_date", ["order_date", "order_id"], "1999-01-01", "1999-06-30", dims=["region"]
    )
    assert parts["top_driver"].first()["item"] == "ASIA"


def test_empty_period_falls_back_to_halves(shop):
    t = rootcause.with_periods(shop, "order_date", ["order_date", "order_id"], "2030-01-01")
    n = t.agg(F.count_if("in_p1"), F.count_if("in_p2")).first()
    assert tuple(n) == (4800, 2400)
    t = rootcause.with_periods(shop, "order_date", ["order_date", "order_id"])
    assert tuple(t.agg(F.count_if("in_p1"), F.count_if("in_p2")).first()) == (2640, 2160)


def test_report_parts(shop):
    parts = report.executive_report(shop, "shop", ["order_date", "order_id"], with_models=False)
    assert {"quality", "kpis", "findings", "root_cause_items"} <= set(parts)
    assert sum(k.startswith("chart_") for k in parts) == 6
    assert parts["findings"].count() == 4


# ------------------------------------------------------------------- questions

def test_intents(spark):
    cat = intent.Catalogue(["region", "product_category"], ["order_date"], ["revenue", "delivery_delay_days"], "revenue")
    q = spark.createDataFrame(
        [
            (1, "Show top 5 regions by revenue"), (2, "lowest 3 delivery delay by category"), (3, "What is the top category?"),
            (4, "plot revenue over time"), (5, "tell me a joke about cats"), (6, "hello"), (7, "!!!"), (8, "first 999999999999 rows"),
            (9, "20 best products"), (10, "which region sells most"),
        ],
        "id int, question string",
    )
    r = {x["id"]: x for x in intent.intents(q, cat).collect()}
    assert (r[1]["limit"], r[1]["direction"], r[1]["dimension"], r[1]["metric"], r[1]["aggregation"]) == (5, "DESC", "region", "revenue", "sum")
    assert (r[2]["limit"], r[2]["direction"], r[2]["metric"], r[2]["aggregation"]) == (3, "ASC", "delivery_delay_days", "avg")
    assert r[3]["dimension"] == "product_category" and r[3]["chart"] is None
    assert r[4]["chart"] == "line"
    assert [r[i]["off_topic"] for i in (1, 5, 6, 7)] == [False, True, False, True]
    assert r[8]["limit"] == 50 and r[9]["limit"] == 20 and r[10]["dimension"] == "region"


def test_log_answers_equal_single_answers(spark, shop):
    cat = intent.Catalogue(["region", "product_category"], [], ["revenue", "quantity"], "revenue")
    q = spark.createDataFrame([("top 3 region by revenue",), ("lowest 2 region by quantity",)], "question string")
    log = ask.answer_log(shop, intent.intents(q, cat), cat)
    one = ask.answer_one(shop, "region", "revenue", "sum", "DESC", 3).collect()
    got = log.filter("metric = 'revenue'").orderBy("rank").collect()
    assert [(r["label"], r["value"], r["count"]) for r in got] == [tuple(r) for r in one]
    assert log.filter("metric = 'quantity'").count() == 2


def test_retrieval_falls_back_to_the_first_chunks(spark, shop):
    chunks = retrieval.knowledge_chunks(shop.select("region", "revenue", "order_date"), "ecommerce")
    q = spark.createDataFrame([(1, "which region is the best?"), (2, "zzz qqq")], "id int, question string")
    got = retrieval.retrieve(q, chunks, ["id"]).collect()
    assert [r["chunk_id"] for r in sorted((x for x in got if x["id"] == 1), key=lambda x: x["rank"])][0] == "col_cat_region"
    assert sorted((r["rank"], r["score"]) for r in got if r["id"] == 2) == [(1, 0), (2, 0), (3, 0)]


def test_sql_guard(spark):
    ok = ["SELECT 1", "  with t as (select 1 as x) select * from t ; ", "SELECT 'drop table x' AS credit_limit"]
    bad = [
        "", "   ", "DROP TABLE orders;", "SELECT * FROM orders; DELETE FROM users;", "UPDATE users SET role='admin'", "SET spark.x=1",
        "SELECT replace('a','b','c')", "SELECT 1 /* x */ ; drop table t", "SELECT pg_sleep(5)", "WITH t AS (SELECT 1) INSERT INTO x SELECT * FROM t",
    ]
    for text in ok:
        assert sqlsurface.guarded_sql(spark, text).count() == 1
    for text in bad:
        with pytest.raises(sqlsurface.UnsafeSQL):
            sqlsurface.guarded_sql(spark, text)


def test_sql_reads_registered_views_only(spark, tmp_path):
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("probe_one")
    for text in ("SELECT * FROM probe_one", "-- note\nSELECT x FROM probe_one", "(SELECT x FROM probe_one)", "WITH a AS (SELECT x FROM probe_one) SELECT * FROM a", "SELECT x FROM probe_one WHERE x IN (SELECT x FROM probe_one)"):
        assert sqlsurface.guarded_sql(spark, text, None).count() == 1
    for text in (f"SELECT * FROM text.`{tmp_path}`", "SELECT reflect('java.lang.System', 'getenv', 'PATH')", "SELECT * FROM no_such_view", "SELECT (SELECT max(x) FROM default.other) FROM probe_one"):
        with pytest.raises(sqlsurface.UnsafeSQL):
            sqlsurface.guarded_sql(spark, text)


def test_dates_in_many_forms(spark):
    from dataprobe.operators import shape

    forms = {"1/5/2024": "2024-01-05", "12/25/2024 14:30": "2024-12-25", "25/12/2024": "2024-12-25", "13-Jan-2024": "2024-01-13", "Jan 5, 2024": "2024-01-05", "2024/1/5": "2024-01-05", "5-1-2024": "2024-01-05", "2024-01-05T10:00:00": "2024-01-05", "n/a": None, "99/99/2024": None}
    df = spark.createDataFrame([(k,) for k in forms], "d string").select("d", shape.parse_timestamp("d").cast("date").cast("string").alias("p"))
    assert {r.d: r.p for r in df.collect()} == forms


def test_more_than_a_hundred_classes(spark):
    df = spark.createDataFrame([(i, f"c{i % 150:03d}", float(i % 7), float(i % 150)) for i in range(900)], "n int, target string, a double, b double")
    assert rootcause.incidence(df, "target").first()["positive_class"] == "c001"
    score, best = rootcause.classifier(df, "target", trees=3, depth=2)
    assert score.count() == 1 and best.count() >= 1
    drivers, scores = models.target_drivers(df, "target", trees=3, depth=2)
    assert scores.count() == 2


def test_forest_with_missing_values_keeps_its_trees(spark):
    from dataprobe.operators import iforest

    df = spark.createDataFrame([(i, float(i % 13) if i != 77 else None, float(i % 5)) for i in range(600)], "id int, a double, b double")
    nodes, _ = iforest.fit(df, ["a", "b"], ["id"], trees=10)
    assert all(r["count"] > 1 for r in nodes.groupBy("tree").count().collect())


def test_no_columns_to_answer_with(spark):
    from dataprobe.operators import ask, intent

    df = spark.createDataFrame([("x", 1.0), ("y", 2.0), (None, 3.0)], "name string, v double")
    q = spark.createDataFrame([("total v",), ("how many records",)], "question string")
    bare = intent.Catalogue([], [], [])
    got = ask.answer_log(df, intent.intents(q, bare).withColumn("off_topic", F.lit(False)), bare).collect()
    assert got and all((r.label, r.value) == ("All records", 3.0) for r in got)
    no_dims = intent.Catalogue([], [], ["v"])
    got = ask.answer_log(df, intent.intents(q, no_dims).withColumn("off_topic", F.lit(False)), no_dims).collect()
    assert {r.value for r in got if r.aggregation == "sum"} == {6.0}


def test_explain_picks_by_target(spark):
    rows = [(i, f"2024-{1 + i // 28 % 12:02d}-{1 + i % 28:02d}", "a" if i % 3 else "b", "yes" if i % 3 == 0 else "no", 10.0 + (i % 3 == 0) * 5 + i % 97 / 97) for i in range(600)]
    df = spark.createDataFrame(rows, "n int, day_text string, grp string, churned string, spend double")
    got = rootcause.explain(df, "churned", ["n"])
    n = got["narrative"].first()
    assert n.what_happened == "Churned outcome rate is 33.3% across 600 records." and "highest rate in 'b' of Grp (100.0%)" in n.why_it_happened
    assert {r.dimension for r in got["by_dimension"].collect()} == {"grp"}
    got = rootcause.explain(df.withColumnRenamed("day_text", "day_date"), "spend", ["n"])
    assert got["totals"].count() == 1 and "priority" not in got
    parts = report.executive_report(df, "people", ["n"], target="churned", with_models=False)
    assert parts["findings"].count() == 4


def test_dates_are_resolved(spark):
    df = spark.createDataFrame([(i, "x", f"{1 + i % 12}/{1 + i % 28}/2024") for i in range(40)], "n int, other_time string, order_date string")
    got = rootcause.resolve_dates(df, "other_time", ["n"]).select("n", F.col("resolved_date").cast("date").alias("d")).collect()
    assert {r.n: str(r.d) for r in got}[3] == "2024-04-04"
    assert str(rootcause.resolve_dates(df.select("n"), None, ["n"]).agg(F.max(F.to_date("resolved_date"))).first()[0]) == "2024-02-09"


def test_top_k_takes_any_k(spark):
    from dataprobe.operators import ordering

    assert ordering.top_k(spark.range(300).selectExpr("id as v", "cast(id as string) as l"), "v", "l", 100).count() == 100


def test_sql_limit_holds_beside_a_column_named_limit(spark):
    assert sqlsurface.guarded_sql(spark, "SELECT id AS credit_limit FROM range(5000)").count() == 1000


def test_audit_of_a_long_literal(spark):
    long = "SELECT '" + "drop ''x'' " * 20000 + "' AS a"
    df = spark.createDataFrame([(long,)], "statement string")
    assert sqlsurface.audit(df).first()["verdict"] == "safe"


def test_forests_read_their_input_once_and_in_bounded_partitions(spark, monkeypatch):
    from dataprobe.scratch import materialise, spread

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    n = 600
    plain = spark.range(n).select(
        F.concat(F.lit("o"), "id").alias("order_id"), (F.col("id") % 7).cast("double").alias("a"), F.pmod(F.xxhash64("id"), F.lit(90)).cast("double").alias("b"),
        F.element_at(F.array(F.lit("x"), F.lit("y")), (F.col("id") % 2 + 1).cast("int")).alias("kind"), (F.col("id") % 7 < 3).cast("int").alias("flag"),
        (F.col("id") % 7 * 10 + F.rand(1)).alias("revenue"),
    )
    df = plain.mapInArrow(counted, plain.schema)
    sizes = []
    monkeypatch.setattr(models, "FOREST_ROWS", 40)
    whole = models.assemble
    monkeypatch.setattr(models, "assemble", lambda frame, used: sizes.append(frame.rdd.getNumPartitions()) or whole(frame, used))
    fits = (
        lambda: rootcause.classifier(df, "flag", trees=3, depth=2), lambda: rootcause.regression_drivers(df, "revenue", trees=3, depth=2),
        lambda: models.target_drivers(df, "revenue", trees=3, depth=2, key=["order_id"]), lambda: models.risk_model(df, "flag", ["order_id"], trees=3, depth=2),
    )
    for fit in fits:
        read.value = 0
        sizes.clear()
        fit()
        assert read.value == n and max(sizes) >= n / 40
    table = materialise(plain, "plain")
    assert spread(table, 40).rdd.glom().map(len).max() <= 80 and spread(table, 40).count() == n


def test_values_are_counted_in_tasks_of_bounded_size(spark):
    from dataprobe.operators.aggregates import value_counts_by_column

    df = spark.range(300_000, numPartitions=1).select(F.col("id").alias("a"), (F.col("id") * 7 % 1000).alias("b"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        counts = value_counts_by_column(df, ["a", "b"])
        assert {r["column"]: (r["n"], r["rows"]) for r in counts.groupBy("column").agg(F.count("*").alias("n"), F.sum("count").alias("rows")).collect()} == {"a": (300_000, 300_000), "b": (1000, 300_000)}
        # the rows of one split reach the grouping in several tasks: each b is counted in each of them
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Aggregate") < plan.index("Expand") < plan.index("RebalancePartitions")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_facts_of_texts_sort_no_rows(spark):
    from dataprobe.operators.profile import column_facts

    df = spark.createDataFrame([("b", "2024-01-02", 1), (None, "x", 2), ("a", "1", 3)], "s string, t string, n int")
    facts = {r["column_name"]: (r["rows"], r["missing_count"], r["not_boolean"], r["dates"], r["lo"], r["hi"]) for r in column_facts(df).collect()}
    assert facts == {"s": (3, 1, 2, 0, "a", "b"), "t": (3, 0, 2, 1, "1", "x"), "n": (3, 0, 2, 0, "1.0", "3.0")}
    assert [r["rows"] for r in column_facts(df.limit(0)).collect()] == [0, 0, 0]
    assert "Sort " not in column_facts(df)._jdf.queryExecution().executedPlan().toString()
