"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataprobe.functions.numeric import half_even, pearson, sample_skewness
from dataprobe.operators import aggregates as agg
from dataprobe.operators.quantiles import quantile_row
from dataprobe.plans.inputs import EVENTS_DIRTY, SALES, events_dirty, sales
from dataprobe.plans.registry import query, table
from dataprobe.sources.readers import register_view


def _breakdown(name, how, expr):
    sql = f"""WITH {SALES} SELECT nation AS label, CAST({expr} AS DOUBLE) AS value, count(*) AS count
              FROM sales WHERE nation IS NOT NULL GROUP BY nation"""

    @query(name, sql)
    def run(spark, sf_dir):
        return agg.breakdown(sales(spark, sf_dir), "nation", "revenue", how)


_breakdown("agg_sum", "sum", "round_even(CAST(sum(revenue) AS DOUBLE), 2)")
_breakdown("agg_avg", "avg", "round_even(avg(revenue), 2)")
_breakdown("agg_count", "count", "count(*)")
_breakdown("agg_max", "max", "round_even(CAST(max(revenue) AS DOUBLE), 2)")
_breakdown("agg_min", "min", "round_even(CAST(min(revenue) AS DOUBLE), 2)")


@query(
    "agg_global",
    f"WITH {SALES} SELECT round_even(CAST(sum(revenue) AS DOUBLE), 2) AS value, count(*) AS count FROM sales",
)
def agg_global(spark, sf_dir):
    return agg.breakdown(sales(spark, sf_dir), None, "revenue", "sum")


DAILY_ORDERS = """daily AS (SELECT CAST(o_orderdate AS DATE) AS date,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v, count(*) AS n FROM orders GROUP BY 1)"""


def daily_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return agg.daily_rollup(o, "o_orderdate", "price")


@query(
    "daily_rollup",
    f"""WITH {DAILY_ORDERS}
        SELECT strftime(date, '%Y-%m-%d') AS date, round_even(v, 2) AS sum_val, round(v / n, 8) AS mean_val, n AS count
        FROM daily""",
)
def daily_rollup(spark, sf_dir):
    d = daily_orders(spark, sf_dir)
    return d.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        half_even(F.col("sum_val"), 2).alias("sum_val"),
        F.round(F.col("sum_val") / F.col("count"), 8).alias("mean_val"),
        "count",
    )


_PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(
    "distinct_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM part" for c in _PART_COLUMNS),
)
def distinct_counts(spark, sf_dir):
    return agg.distinct_counts(table(spark, sf_dir, "part"))


_DIRTY_COLUMNS = ["event_id", "ts", "user_id", "event_type", "channel", "value", "source", "is_error"]


@query(
    "missing_counts",
    f"WITH {EVENTS_DIRTY} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, count(*) AS rows,
            round_even((count(*) - count({c})) / count(*) * 100, 2) AS missing_percent FROM dirty"""
        for c in _DIRTY_COLUMNS
    ),
)
def missing_counts(spark, sf_dir):
    return agg.missing_counts(events_dirty(spark, sf_dir))


@query(
    "quantiles",
    """SELECT 'l_extendedprice' AS "column", round(quantile_cont(l_extendedprice, 0.25), 4) AS q25,
              round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75
       FROM lineitem UNION ALL
       SELECT 'l_discount', round(quantile_cont(l_discount, 0.25), 4), round(quantile_cont(l_discount, 0.5), 4),
              round(quantile_cont(l_discount, 0.75), 4) FROM lineitem""",
)
def quantiles(spark, sf_dir):
    cols = ["l_extendedprice", "l_discount"]
    row = quantile_row(table(spark, sf_dir, "lineitem").select(*cols), cols, [0.25, 0.5, 0.75])
    long = row.unpivot([], cols, "column", "q")
    return long.select("column", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q25", "q50", "q75"))])


@query("skewness_adj", "SELECT event_type, round(skewness(value), 6) AS skew FROM events GROUP BY event_type")
def skewness_adj(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(sample_skewness("value"), 6).alias("skew"))


@query(
    "mode_smallest",
    f"""WITH {EVENTS_DIRTY}, c AS (
          SELECT 'event_type' AS "column", event_type AS v, count(*) AS n FROM dirty WHERE event_type IS NOT NULL GROUP BY event_type
          UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM dirty GROUP BY user_id
          UNION ALL SELECT 'source', source, count(*) FROM dirty GROUP BY source),
        r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS rn FROM c)
        SELECT "column", v AS mode, n AS count FROM r WHERE rn = 1""",
)
def mode_smallest(spark, sf_dir):
    return agg.modes(events_dirty(spark, sf_dir), ["event_type", "user_id", "source"])


@query(
    "value_counts_topk",
    "SELECT p_brand AS value, count(*) AS count FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY count DESC, value LIMIT 10",
)
def value_counts_topk(spark, sf_dir):
    return agg.value_counts(table(spark, sf_dir, "part"), "p_brand", 10)


@query(
    "corr_pair",
    """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, CAST(NULL AS DOUBLE) AS r_constant
       FROM lineitem GROUP BY l_returnflag""",
)
def corr_pair(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(
        F.round(pearson("l_quantity", "l_extendedprice"), 6).alias("r"),
        pearson(F.col("l_quantity"), F.lit(1.0)).alias("r_constant"),
    )


@query(
    "duplicate_count",
    f"""WITH {EVENTS_DIRTY}
        SELECT (SELECT count(*) FROM dirty) AS rows,
               (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_rows""",
)
def duplicate_count(spark, sf_dir):
    return agg.duplicate_count(events_dirty(spark, sf_dir))


@query(
    "agg_multi_measure",
    f"""WITH {SALES} SELECT region, CAST(sum(revenue) AS DOUBLE) AS revenue, round(avg(quantity), 4) AS avg_quantity,
               CAST(sum(CAST(priority = '1-URGENT' AS INTEGER)) AS BIGINT) AS urgent, count(*) AS lines
        FROM sales GROUP BY region""",
)
def agg_multi_measure(spark, sf_dir):
    return sales(spark, sf_dir).groupBy("region").agg(
        F.sum("revenue").cast("double").alias("revenue"),
        F.round(F.avg("quantity"), 4).alias("avg_quantity"),
        F.sum((F.col("priority") == "1-URGENT").cast("int")).alias("urgent"),
        F.count(F.lit(1)).alias("lines"),
    )


@query(
    "share_of_total",
    f"""WITH {SALES}, g AS (SELECT nation, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY nation)
        SELECT nation, revenue, round_even(revenue / (SELECT sum(revenue) FROM g) * 100, 1) AS share FROM g""",
)
def share_of_total(spark, sf_dir):
    g = sales(spark, sf_dir).groupBy("nation").agg(F.sum("revenue").cast("double").alias("revenue"))
    return agg.share_of_total(g, "revenue")


_GROUPING = """SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status,
       CAST(grouping(l_returnflag) AS INTEGER) AS g1, CAST(grouping(l_linestatus) AS INTEGER) AS g2,
       CAST(sum(l_quantity) AS DOUBLE) AS quantity, count(*) AS n
FROM {} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())"""


@query("sql_grouping_sets", _GROUPING.format("lineitem"))
def sql_grouping_sets(spark, sf_dir):
    register_view(spark, "probe_lineitem", f"{sf_dir}/lineitem.parquet")
    return spark.sql(_GROUPING.format("probe_lineitem"))
