"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataprobe.functions.numeric import whole_days_between
from dataprobe.operators import joining, shape
from dataprobe.plans.inputs import SALES, sales
from dataprobe.plans.registry import query, table
from dataprobe.sources.readers import register_view

PERIOD_SQL = """CASE WHEN order_date < DATE '1999-01-01' THEN 'p1' WHEN order_date <= DATE '1999-06-30' THEN 'p2' END"""


@query(
    "full_outer_periods",
    f"""WITH {SALES}, a AS (SELECT nation, sum(revenue) AS p1 FROM sales WHERE {PERIOD_SQL} = 'p1' GROUP BY nation),
        b AS (SELECT nation, sum(revenue) AS p2 FROM sales WHERE {PERIOD_SQL} = 'p2' GROUP BY nation)
        SELECT coalesce(a.nation, b.nation) AS nation, CAST(coalesce(p1, 0) AS DOUBLE) AS p1,
               CAST(coalesce(p2, 0) AS DOUBLE) AS p2
        FROM a FULL OUTER JOIN b ON a.nation = b.nation""",
)
def full_outer_periods(spark, sf_dir):
    period = shape.tag_period("order_date", "1999-01-01", "1999-06-30")
    pairs = joining.align_periods(sales(spark, sf_dir), "nation", period, F.col("revenue"))
    return pairs.select("nation", F.col("p1").cast("double").alias("p1"), F.col("p2").cast("double").alias("p2"))


@query(
    "calendar_join",
    """WITH d AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) + CAST(o_orderkey % 3 AS INTEGER) AS date, count(*) AS orders FROM orders GROUP BY 1),
       c AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d)
       SELECT strftime(c.date, '%Y-%m-%d') AS date, coalesce(orders, 0) AS orders FROM c LEFT JOIN d ON c.date = d.date""",
)
def calendar_join(spark, sf_dir):
    """All orders, booked on the first three days of their week, so that the other days are gaps."""
    booked = F.date_add(F.trunc("o_orderdate", "week"), (F.col("o_orderkey") % 3).cast("int"))
    daily = table(spark, sf_dir, "orders").groupBy(booked.alias("date")).agg(F.count(F.lit(1)).alias("orders"))
    dense = joining.dense_calendar(daily)
    return dense.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query(
    "broadcast_stats",
    """WITH s AS (SELECT max(o_orderdate) AS last, avg(o_totalprice) AS mean FROM orders)
       SELECT o_orderstatus, CAST(sum(date_diff('day', o_orderdate, last)) AS BIGINT) AS days,
              count(*) FILTER (o_totalprice > mean) AS above_mean
       FROM orders, s GROUP BY o_orderstatus""",
)
def broadcast_stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderdate", "o_totalprice")
    both = joining.with_stats(o, F.max("o_orderdate").alias("last"), F.avg("o_totalprice").alias("mean"))
    return both.groupBy("o_orderstatus").agg(
        F.sum(whole_days_between(F.col("last"), F.col("o_orderdate"))).alias("days"),
        F.count_if(F.col("o_totalprice") > F.col("mean")).alias("above_mean"),
    )


@query(
    "semi_isin",
    """SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
       AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""",
)
def semi_isin(spark, sf_dir):
    urgent = joining.keep_members(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])
    builders = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return joining.keep_members(urgent, "o_custkey", builders).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def _views(spark, sf_dir, *names):
    for n in names:
        register_view(spark, f"probe_{n}", f"{sf_dir}/{n}.parquet")


@query(
    "sql_join_inner",
    """SELECT n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS orders
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def sql_join_inner(spark, sf_dir):
    _views(spark, sf_dir, "orders", "customer", "nation")
    return spark.sql(
        """SELECT n_name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS orders
           FROM probe_orders JOIN probe_customer ON o_custkey = c_custkey
           JOIN probe_nation ON c_nationkey = n_nationkey GROUP BY n_name"""
    )


@query(
    "sql_join_semi_anti",
    """SELECT c_mktsegment, 'with large order' AS kind, count(*) AS n FROM customer
       WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) GROUP BY c_mktsegment
       UNION ALL
       SELECT c_mktsegment, 'without', count(*) FROM customer
       WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) GROUP BY c_mktsegment""",
)
def sql_join_semi_anti(spark, sf_dir):
    _views(spark, sf_dir, "orders", "customer")
    return spark.sql(
        """SELECT c_mktsegment, 'with large order' AS kind, count(*) AS n
           FROM probe_customer LEFT SEMI JOIN probe_orders ON o_custkey = c_custkey AND o_totalprice > 450000
           GROUP BY c_mktsegment
           UNION ALL
           SELECT c_mktsegment, 'without', count(*)
           FROM probe_customer LEFT ANTI JOIN probe_orders ON o_custkey = c_custkey AND o_totalprice > 450000
           GROUP BY c_mktsegment"""
    )


@query(
    "sql_join_range",
    """WITH bands AS (SELECT n_nationkey AS band, n_nationkey * 20000 AS lo, (n_nationkey + 1) * 20000 AS hi FROM nation)
       SELECT band, count(*) AS n FROM orders JOIN bands ON o_totalprice >= lo AND o_totalprice < hi GROUP BY band""",
)
def sql_join_range(spark, sf_dir):
    _views(spark, sf_dir, "orders", "nation")
    return spark.sql(
        """WITH bands AS (SELECT n_nationkey AS band, n_nationkey * 20000 AS lo, (n_nationkey + 1) * 20000 AS hi
                          FROM probe_nation)
           SELECT band, count(*) AS n FROM probe_orders JOIN bands ON o_totalprice >= lo AND o_totalprice < hi
           GROUP BY band"""
    )
