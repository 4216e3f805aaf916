"""Smoothing and trailing frames over raw rows, in the order of the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataprobe.operators import splits
from dataprobe.plans.forecasting import holt_sql
from dataprobe.plans.registry import query, table


@query(
    "holt_scan",
    f"""WITH e AS (SELECT event_id, ts, event_type, value FROM events UNION ALL SELECT event_id, ts, 'all', value FROM events),
        a AS (SELECT event_type, list(value ORDER BY ts, event_id) AS vs FROM e GROUP BY event_type),
        h AS (SELECT event_type, {holt_sql('vs')} AS s, len(vs) AS n FROM a)
        SELECT event_type, round(s.l, 3) AS level, round(s.t, 4) AS trend, CAST(n AS BIGINT) AS points FROM h""",
)
def holt_scan(spark, sf_dir):
    """Every event of a type, and of all types together as one long series."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    each = splits.holt_scan(e, "value", ["ts", "event_id"], keys=["event_type"])
    whole = splits.holt_scan(e, "value", ["ts", "event_id"]).select(F.lit("all").alias("event_type"), "level", "trend", "points")
    return each.unionByName(whole).select("event_type", F.round("level", 3).alias("level"), F.round("trend", 4).alias("trend"), "points")


_FRAME = "(ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@query(
    "rolling_raw",
    f"""SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER {_FRAME}, 4) AS mean7, round(coalesce(stddev_samp(l_quantity) OVER {_FRAME}, 0), 4) AS std7,
               CASE WHEN count(l_quantity) OVER {_FRAME} >= 3 THEN round(avg(l_quantity) OVER {_FRAME}, 4) END AS mean_min3,
               l_quantity - lag(l_quantity) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS difference FROM lineitem""",
)
def rolling_raw(spark, sf_dir):
    v = F.col("l_quantity")

    def columns(w):
        frame = w.rowsBetween(-6, 0)
        mean = F.round(F.avg(v).over(frame), 4)
        return {
            "mean7": mean, "std7": F.round(F.coalesce(F.stddev_samp(v).over(frame), F.lit(0.0)), 4),
            "mean_min3": F.when(F.count(v).over(frame) >= 3, mean), "difference": v - F.lag(v).over(w),
        }

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    out = splits.with_trailing(rows, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 7, columns)
    return out.select("l_orderkey", "l_linenumber", "mean7", "std7", "mean_min3", "difference")
