"""Daily anomalies and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataprobe.operators import timeseries as ts
from dataprobe.operators.aggregates import daily_rollup
from dataprobe.operators.iforest import isolate
from dataprobe.plans.aggregates import DAILY_ORDERS, daily_orders
from dataprobe.plans.registry import query, table


def day():
    return F.date_format("date", "yyyy-MM-dd").alias("date")



def _band_sql(frame, enough):
    return f"""{DAILY_ORDERS}, w AS (SELECT date, v, n, avg(v) OVER f AS expected, coalesce(stddev_samp(v) OVER f, 0) AS s, count(v) OVER f AS k
      FROM daily WINDOW f AS (ORDER BY date ROWS BETWEEN {frame})),
      band AS (SELECT date, v, n, expected, greatest(0.0, expected - 2.5 * s) AS lower_bound, expected + 2.5 * s AS upper_bound,
        coalesce({enough} AND (v > expected + 2.5 * s OR v < greatest(0.0, expected - 2.5 * s)), false) AS is_outside FROM w)"""


CURRENT = _band_sql("6 PRECEDING AND CURRENT ROW", "true")
PRIOR = _band_sql("7 PRECEDING AND 1 PRECEDING", "k >= 2")
_SHOW = "strftime(date, '%Y-%m-%d') AS date, round(expected, 4) AS expected, round(lower_bound, 4) AS lower_bound, round(upper_bound, 4) AS upper_bound, is_outside"


def _shown(b):
    r = lambda c: F.round(c, 4).alias(c)
    return b.select(day(), r("expected"), r("lower_bound"), r("upper_bound"), "is_outside")


@query("anomaly_band", f"WITH {CURRENT} SELECT {_SHOW} FROM band")
def anomaly_band(spark, sf_dir):
    return _shown(ts.anomaly_band(daily_orders(spark, sf_dir), include_current=True))


@query("anomaly_band_prior", f"WITH {PRIOR} SELECT {_SHOW} FROM band WHERE expected IS NOT NULL")
def anomaly_band_prior(spark, sf_dir):
    return _shown(ts.anomaly_band(daily_orders(spark, sf_dir)).filter("expected IS NOT NULL"))


@query(
    "anomaly_severity",
    f"""WITH {PRIOR}, f AS (SELECT *, v - expected AS diff, round_even((v - expected) / greatest(abs(expected), 1) * 100, 1) AS change_percent FROM band WHERE is_outside)
        SELECT strftime(date, '%Y-%m-%d') AS date, 'total_price' AS metric, round_even(v, 2) AS actual_value, round_even(expected, 2) AS expected_value,
               round_even(lower_bound, 2) AS lower_bound, round_even(upper_bound, 2) AS upper_bound,
               CASE WHEN abs(change_percent) > 40 THEN 'Critical' WHEN abs(change_percent) > 25 THEN 'Medium' ELSE 'Low' END AS severity,
               change_percent, CASE WHEN diff < 0 THEN 'Drop' ELSE 'Spike' END AS direction,
               'Total Price had an unusual ' || CASE WHEN diff < 0 THEN 'drop of ' || printf('%.1f', abs(change_percent)) || '%'
                 ELSE 'surge of +' || printf('%.1f', change_percent) || '%' END || ' compared to the expected range.' AS explanation FROM f""",
)
def anomaly_severity(spark, sf_dir):
    r = ts.anomaly_records(ts.anomaly_band(daily_orders(spark, sf_dir)), "total_price")
    return r.drop("anomaly_score").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("anomaly_iforest")
def anomaly_iforest(spark, sf_dir):
    isolated = isolate(daily_orders(spark, sf_dir), ["sum_val", "count"], ["date"])
    return ts.anomaly_records(ts.anomaly_band(isolated), "total_price").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


# ------------------------------------------------------------------- forecast

def _daily(spark, sf_dir):
    return daily_orders(spark, sf_dir).select("date", F.col("sum_val").alias("value"))


def holt_sql(values: str) -> str:
    """Level and trend struct of a list expression named ``values``; plain fold over the list."""
    start = f"(({values})[least(len({values}), 5)] - ({values})[1]) / nullif(least(len({values}), 5) - 1, 0)"
    return f"""list_reduce(
      list_prepend({{'l': ({values})[1]::DOUBLE, 't': coalesce({start}, 0)::DOUBLE, 'v': 0::DOUBLE}},
                   list_transform({values}, lambda x: {{'l': 0::DOUBLE, 't': 0::DOUBLE, 'v': x::DOUBLE}})),
      lambda a, x: {{'l': 0.35::DOUBLE * x.v + 0.65::DOUBLE * (a.l + a.t),
                     't': 0.15::DOUBLE * ((0.35::DOUBLE * x.v + 0.65::DOUBLE * (a.l + a.t)) - a.l) + 0.85::DOUBLE * a.t, 'v': x.v}})"""


SERIES = f"{DAILY_ORDERS}, arr AS (SELECT list(v ORDER BY date) AS vs, max(date) AS last_date, avg(v) AS mean FROM daily)"


@query(
    "holt_state",
    f"WITH {SERIES}, h AS (SELECT {holt_sql('vs')} AS s, len(vs) AS n FROM arr) SELECT round(s.l, 3) AS level, round(s.t, 4) AS trend, CAST(n AS INTEGER) AS points FROM h",
)
def holt_state(spark, sf_dir):
    return ts.holt_state(_daily(spark, sf_dir)).select(F.round("level", 3).alias("level"), F.round("trend", 4).alias("trend"), "points")


@query(
    "holt_state_by_status",
    f"""WITH d AS (SELECT o_orderstatus AS k, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY ALL),
        arr AS (SELECT k, list(v ORDER BY date) AS vs FROM d GROUP BY k), h AS (SELECT k, {holt_sql('vs')} AS s, len(vs) AS n FROM arr)
        SELECT k AS o_orderstatus, round(s.l, 3) AS level, round(s.t, 4) AS trend, CAST(n AS INTEGER) AS points FROM h""",
)
def holt_state_by_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    d = daily_rollup(o, "o_orderdate", "price", ["o_orderstatus"]).withColumnRenamed("sum_val", "value")
    s = ts.holt_state(d, keys=["o_orderstatus"])
    return s.select("o_orderstatus", F.round("level", 3).alias("level"), F.round("trend", 4).alias("trend"), "points")


def forecast_sql(h: int) -> str:
    return f"""{SERIES}, st AS (SELECT {holt_sql('vs')} AS s, last_date, mean FROM arr),
      df AS (SELECT stddev_pop(d) AS sd, count(d) AS k FROM (SELECT v - lag(v) OVER (ORDER BY date) AS d FROM daily)),
      g AS (SELECT CAST(unnest(range(1, {h + 1})) AS INTEGER) AS h), p AS (
        SELECT last_date + h AS date, h, greatest(0.0, s.l + h * s.t) AS pred,
               1.96 * CASE WHEN k > 1 AND sd > 0 THEN sd ELSE greatest(1.0, mean * 0.08) END * sqrt(h) AS m FROM g, st, df),
      fc AS (SELECT strftime(date, '%Y-%m-%d') AS date, h, round_even(pred, 2) AS predicted, round_even(greatest(0.0, pred - m), 2) AS lower_bound,
             round_even(pred + m, 2) AS upper_bound FROM p)"""


def _forecast(days):
    @query(f"holt_forecast_{days}", f"WITH {forecast_sql(days)} SELECT * FROM fc")
    def run(spark, sf_dir):
        return ts.forecast(_daily(spark, sf_dir), days).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


for _days in (7, 30, 90):
    _forecast(_days)


@query(
    "holt_backtest",
    f"""WITH {SERIES}, c AS (SELECT vs, CAST(greatest(floor(len(vs) * 0.8::DOUBLE), len(vs) - 10) AS INTEGER) AS cut FROM arr),
        tr AS (SELECT vs[1:cut] AS train, vs[cut + 1:] AS test FROM c), s AS (SELECT {holt_sql('train')} AS s, test FROM tr),
        e AS (SELECT unnest(test) AS y, unnest(range(1, len(test) + 1)) AS i, s.l AS l, s.t AS t FROM s),
        r AS (SELECT y, y - greatest(0.0, l + i * t) AS e FROM e),
        m AS (SELECT round_even(avg(abs(e)), 2) AS mae, round_even(sqrt(avg(e * e)), 2) AS rmse,
                     least(99.9, round_even(avg(abs(e) / greatest(abs(y), 1)) * 100, 1))::DOUBLE AS mape, CAST(count(*) AS INTEGER) AS tested FROM r)
        SELECT mae, rmse, mape, greatest(1.0, round_even(100 - mape, 1))::DOUBLE AS accuracy, tested FROM m""",
)
def holt_backtest(spark, sf_dir):
    return ts.backtest(_daily(spark, sf_dir))


@query(
    "forecast_densify",
    """WITH d AS (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS date, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1),
       n AS (SELECT min(date) AS a, max(date) AS b, count(*) AS n FROM d),
       c AS (SELECT CAST(unnest(generate_series(a, b + CAST(14 - n AS INTEGER), INTERVAL 1 DAY)) AS DATE) AS date FROM n),
       k AS (SELECT c.date, v, CASE WHEN v IS NOT NULL THEN c.date END AS kd FROM c LEFT JOIN d ON c.date = d.date),
       w AS (SELECT date, v, last_value(v IGNORE NULLS) OVER (ORDER BY date) AS pv, last_value(kd IGNORE NULLS) OVER (ORDER BY date) AS pd,
               first_value(v IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
               first_value(kd IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nd FROM k)
       SELECT strftime(date, '%Y-%m-%d') AS date, round(coalesce(v, pv + (nv - pv) * (date - pd) / (nd - pd), pv, nv), 6) AS value FROM w""",
)
def forecast_densify(spark, sf_dir):
    """Yearly order counts: seven points, fewer than a series needs."""
    o = table(spark, sf_dir, "orders")
    year = F.trunc(F.to_date("o_orderdate"), "year").alias("date")
    d = o.groupBy(year).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return ts.densify(d).select(day(), F.round("value", 6).alias("value"))


@query(
    "forecast_summary",
    f"""WITH {forecast_sql(30)}, e AS (SELECT arg_min(predicted, h) AS first_predicted, arg_max(predicted, h) AS last_predicted FROM fc),
        q AS (SELECT *, round_even((last_predicted - first_predicted) / greatest(abs(first_predicted), 1) * 100, 1) AS change_percent FROM e)
        SELECT *, 'Over the next 30 days, Total Price is projected to ' || CASE WHEN change_percent >= 0 THEN 'expand' ELSE 'decline' END || ' by '
          || printf('%.1f', abs(change_percent)) || '% (from ' || format('{{:,.2f}}', first_predicted) || ' to ' || format('{{:,.2f}}', last_predicted) || ').' AS summary FROM q""",
)
def forecast_summary(spark, sf_dir):
    return ts.forecast_summary(ts.forecast(_daily(spark, sf_dir), 30), "total_price")


@query(
    "forecast_history",
    f"WITH {DAILY_ORDERS} SELECT strftime(date, '%Y-%m-%d') AS date, v AS value FROM daily ORDER BY date DESC LIMIT 45",
)
def forecast_history(spark, sf_dir):
    return ts.history(_daily(spark, sf_dir)).select(day(), "value")
