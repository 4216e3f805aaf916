"""Top-k, last-n, limits, option lists, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataprobe.operators.aggregates import breakdown
from dataprobe.operators.dashboard import option_lists
from dataprobe.operators.ordering import last_n, top_k
from dataprobe.plans.aggregates import DAILY_ORDERS, daily_orders
from dataprobe.plans.inputs import EVENTS_DIRTY, SALES, events_dirty, sales
from dataprobe.plans.registry import query, table
from dataprobe.sources.readers import register_view

_TOPK = """WITH {} SELECT nation AS label, round_even(CAST(sum(revenue) AS DOUBLE), 2) AS value, count(*) AS count
           FROM sales WHERE nation IS NOT NULL GROUP BY nation ORDER BY value {} NULLS LAST, label LIMIT 10"""


@query("topk_desc", _TOPK.format(SALES, "DESC"))
def topk_desc(spark, sf_dir):
    return top_k(breakdown(sales(spark, sf_dir), "nation", "revenue", "sum"), "value", "label", 10)


@query("topk_asc", _TOPK.format(SALES, "ASC"))
def topk_asc(spark, sf_dir):
    return top_k(breakdown(sales(spark, sf_dir), "nation", "revenue", "sum"), "value", "label", 10, ascending=True)


@query(
    "tail_n_days",
    f"WITH {DAILY_ORDERS} SELECT strftime(date, '%Y-%m-%d') AS date, v AS value FROM daily ORDER BY date DESC LIMIT 60",
)
def tail_n_days(spark, sf_dir):
    d = last_n(daily_orders(spark, sf_dir), 60, "date")
    return d.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("sum_val").alias("value"))


@query(
    "filter_options",
    """WITH c AS (SELECT 'p_name' AS "column", p_name AS option FROM part UNION SELECT 'p_brand', p_brand FROM part
                  UNION SELECT 'p_type', p_type FROM part),
       r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY option) AS position FROM c WHERE option IS NOT NULL)
       SELECT "column", option, CAST(position AS INTEGER) AS position FROM r WHERE position <= 15""",
)
def filter_options(spark, sf_dir):
    return option_lists(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


@query(
    "dedup_rows",
    f"""WITH {EVENTS_DIRTY}
        SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, channel, value, source, is_error
        FROM (SELECT DISTINCT * FROM dirty)""",
)
def dedup_rows(spark, sf_dir):
    d = events_dirty(spark, sf_dir).dropDuplicates()
    return d.withColumn("ts", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "union_all",
    """SELECT kind, count(*) AS n, round(sum(acctbal), 2) AS acctbal FROM (
         SELECT 'customer' AS kind, c_acctbal AS acctbal FROM customer
         UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY kind""",
)
def union_all(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("acctbal"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.lit("supplier").alias("kind"))
    both = c.unionByName(s)
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("acctbal"), 2).alias("acctbal"))


_SET_OPS = """SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM {c} INTERSECT SELECT s_nationkey FROM {s})
  UNION ALL SELECT 'customers only', k FROM (SELECT c_nationkey AS k FROM {c} EXCEPT SELECT s_nationkey FROM {s})
  UNION ALL SELECT 'either', k FROM (SELECT c_nationkey AS k FROM {c} UNION SELECT s_nationkey FROM {s})"""


@query("sql_set_ops", _SET_OPS.format(c="customer", s="supplier"))
def sql_set_ops(spark, sf_dir):
    for n in ("customer", "supplier"):
        register_view(spark, f"probe_{n}", f"{sf_dir}/{n}.parquet")
    return spark.sql(_SET_OPS.format(c="probe_customer", s="probe_supplier"))
