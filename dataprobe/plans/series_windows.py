"""Window functions over daily series, and positional or time splits of raw rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataprobe.operators import series, shape
from dataprobe.operators.joining import dense_calendar
from dataprobe.operators.ordering import fill_both_ways, row_index, quantile_bin
from dataprobe.plans.aggregates import DAILY_ORDERS, daily_orders
from dataprobe.plans.registry import query, table

def day():
    return F.date_format("date", "yyyy-MM-dd").alias("date")


SQL_DAY = "strftime(date, '%Y-%m-%d') AS date"
LAST7 = "OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@query("rolling_mean7", f"WITH {DAILY_ORDERS} SELECT {SQL_DAY}, round(avg(v) {LAST7}, 4) AS rolling_mean FROM daily")
def rolling_mean7(spark, sf_dir):
    m = series.rolling_mean(F.col("sum_val"), series.trailing("date"))
    return daily_orders(spark, sf_dir).select(day(), F.round(m, 4).alias("rolling_mean"))


@query(
    "rolling_std7",
    f"WITH {DAILY_ORDERS} SELECT {SQL_DAY}, round(coalesce(stddev_samp(v) {LAST7}, 0), 4) AS rolling_std FROM daily",
)
def rolling_std7(spark, sf_dir):
    s = series.rolling_std(F.col("sum_val"), series.trailing("date"))
    return daily_orders(spark, sf_dir).select(day(), F.round(s, 4).alias("rolling_std"))


@query(
    "rolling_minp3",
    f"""WITH {DAILY_ORDERS} SELECT {SQL_DAY}, CASE WHEN count(v) {LAST7} >= 3 THEN round(avg(v) {LAST7}, 4) END AS m,
        CASE WHEN count(v) {LAST7} >= 3 THEN round(stddev_samp(v) {LAST7}, 4) END AS s FROM daily""",
)
def rolling_minp3(spark, sf_dir):
    m, s = series.rolling_with_minimum(F.col("sum_val"), series.trailing("date"), 3)
    return daily_orders(spark, sf_dir).select(day(), F.round(m, 4).alias("m"), F.round(s, 4).alias("s"))


@query(
    "qcut_bins",
    """WITH g AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey),
       r AS (SELECT *, row_number() OVER (ORDER BY orders, o_custkey) AS rn, count(*) OVER () AS n FROM g)
       SELECT o_custkey, orders,
              CAST(greatest(0, least(3, ceil((rn - 1) * 4.0::DOUBLE / (n - 1)) - 1)) AS INTEGER) AS bin4,
              CAST(greatest(0, least(2, ceil((rn - 1) * 3.0::DOUBLE / (n - 1)) - 1)) AS INTEGER) AS bin3 FROM r""",
)
def qcut_bins(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    n = g.count()
    ranked = row_index(g, [F.col("orders").asc(), F.col("o_custkey").asc()], "_rn")
    bins = [quantile_bin(F.col("_rn"), F.lit(n), q).alias(f"bin{q}") for q in (4, 3)]
    return ranked.select("o_custkey", "orders", *bins)


@query(
    "first_diff",
    f"WITH {DAILY_ORDERS} SELECT {SQL_DAY}, round(v - lag(v) OVER (ORDER BY date), 2) AS diff FROM daily",
)
def first_diff(spark, sf_dir):
    d = series.first_difference(F.col("sum_val"), "date")
    return daily_orders(spark, sf_dir).select(day(), F.round(d, 2).alias("diff"))


@query(
    "fill_ffill_bfill",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 33 <> 0 AND event_id % 10 < 6 THEN ts END AS ts,
                         CASE WHEN event_id % 4 = 3 THEN event_type END AS event_type FROM events)
       SELECT event_id,
         strftime(coalesce(last_value(ts IGNORE NULLS) OVER (ORDER BY event_id),
             first_value(ts IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
             '%Y-%m-%d %H:%M:%S') AS ts,
         coalesce(last_value(event_type IGNORE NULLS) OVER (ORDER BY event_id),
             first_value(event_type IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS event_type
       FROM t""",
)
def fill_ffill_bfill(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        "event_id",
        F.when((k % 33 != 0) & (k % 10 < 6), F.col("ts")).alias("ts"),
        F.when(k % 4 == 3, F.col("event_type")).alias("event_type"),
    )
    filled = fill_both_ways(e, ["ts", "event_type"], ["event_id"])
    return filled.select(
        "event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type"
    )


@query(
    "interpolate_linear",
    """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1),
       d AS (SELECT date, CASE WHEN dayofyear(date) % 4 = 0 THEN n END AS v FROM a),
       c AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d),
       j AS (SELECT c.date, v FROM c LEFT JOIN d ON c.date = d.date),
       k AS (SELECT date, v, CASE WHEN v IS NOT NULL THEN date END AS kd FROM j),
       w AS (SELECT date, v,
               last_value(v IGNORE NULLS) OVER (ORDER BY date) AS pv, last_value(kd IGNORE NULLS) OVER (ORDER BY date) AS pd,
               first_value(v IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
               first_value(kd IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nd FROM k)
       SELECT strftime(date, '%Y-%m-%d') AS date,
              round(coalesce(v, pv + (nv - pv) * (date - pd) / (nd - pd), pv, nv), 6) AS v FROM w""",
)
def interpolate_linear(spark, sf_dir):
    """Orders per day, known on every fourth day of the year only."""
    daily = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    daily = daily.withColumn("v", F.when(F.dayofyear("date") % 4 == 0, F.col("v")))
    return series.interpolate(dense_calendar(daily), "v").select(day(), F.round("v", 6).alias("v"))


@query(
    "period_split_55",
    """WITH t AS (SELECT o_totalprice, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn,
                         count(*) OVER () AS n FROM orders)
       SELECT CASE WHEN rn <= greatest(1, floor(n * 0.55::DOUBLE)) THEN 'p1' ELSE 'p2' END AS period, count(*) AS rows,
              strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day,
              CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM t GROUP BY 1""",
)
def period_split_55(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return _period_facts(shape.split_by_position(o, ["o_orderdate", "o_orderkey"], 0.55))


def _period_facts(tagged):
    fmt = lambda c: F.date_format(c.cast("date"), "yyyy-MM-dd")
    return tagged.groupBy("period").agg(
        F.count(F.lit(1)).alias("rows"),
        fmt(F.min("o_orderdate")).alias("first_day"),
        fmt(F.max("o_orderdate")).alias("last_day"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
    )


_TIME_SPLIT = """WITH c AS (SELECT quantile_cont(epoch_us(o_orderdate)::DOUBLE, {q}) AS cut FROM orders)
   SELECT CASE WHEN epoch_us(o_orderdate) < cut THEN 'p1' ELSE 'p2' END AS period, count(*) AS rows,
          strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day,
          CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
   FROM orders, c GROUP BY 1"""


@query("period_split_median", _TIME_SPLIT.format(q=0.5))
def period_split_median(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    return _period_facts(series.split_at_quantile(o, "o_orderdate", 0.5))


@query("period_split_q60", _TIME_SPLIT.format(q=0.6))
def period_split_q60(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
    return _period_facts(series.split_at_quantile(o, "o_orderdate", 0.6))


@query(
    "series_change",
    f"""WITH {DAILY_ORDERS}, r AS (SELECT *, row_number() OVER (ORDER BY date) AS u, row_number() OVER (ORDER BY date DESC) AS d FROM daily),
        e AS (SELECT arg_min(v, date) AS first_value, arg_max(v, date) AS last_value,
                     avg(v) FILTER (u <= 15) AS head_mean, avg(v) FILTER (d <= 15) AS tail_mean FROM r)
        SELECT first_value, last_value,
               round_even((last_value - first_value) / greatest(abs(first_value), 1) * 100, 1) AS change_percent,
               round(head_mean, 4) AS head_mean, round(tail_mean, 4) AS tail_mean,
               round_even((tail_mean - head_mean) / greatest(abs(head_mean), 1) * 100, 1) AS mean_change_percent FROM e""",
)
def series_change(spark, sf_dir):
    d = daily_orders(spark, sf_dir)
    ends = series.first_to_last(d, "sum_val")
    means = series.head_tail_change(d, "sum_val", 15).select(
        F.round("head_mean", 4).alias("head_mean"),
        F.round("tail_mean", 4).alias("tail_mean"),
        F.col("change_percent").alias("mean_change_percent"),
    )
    return ends.crossJoin(F.broadcast(means))
