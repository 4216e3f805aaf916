"""Projections, filters, casts, generated columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataprobe.functions.numeric import to_number
from dataprobe.operators import shape
from dataprobe.plans.inputs import EVENTS_DIRTY, events_dirty
from dataprobe.plans.registry import query, table


@query(
    "rename_sanitized",
    """SELECT n_nationkey AS nation_key, n_name AS nation_name, n_regionkey AS nation_key_2, 'x' AS col
       FROM nation""",
)
def rename_sanitized(spark, sf_dir):
    messy = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias(" Nation Key"),
        F.col("n_name").alias("Nation  Name!"),
        F.col("n_regionkey").alias("nation_key"),
        F.lit("x").alias("$$"),
    )
    return shape.sanitise_columns(messy)


@query(
    "coerce_numeric",
    """WITH t AS (SELECT o_orderpriority, coalesce(try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE), 0) AS a,
                         coalesce(try_cast(substr(o_orderpriority, 3) AS DOUBLE), 0) AS b,
                         coalesce(try_cast(CAST(o_totalprice AS VARCHAR) AS DOUBLE), 0) AS c FROM orders)
       SELECT o_orderpriority, sum(a) AS first_char, sum(b) AS rest, CAST(sum(CAST(c AS DECIMAL(18,2))) AS DOUBLE) AS price
       FROM t GROUP BY o_orderpriority""",
)
def coerce_numeric(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    return o.groupBy("o_orderpriority").agg(
        F.sum(to_number(p.substr(1, 1))).alias("first_char"),
        F.sum(to_number(F.substring(p, 3, 100))).alias("rest"),
        F.sum(to_number(F.col("o_totalprice").cast("string")).cast("decimal(18,2)")).cast("double").alias("price"),
    )


@query(
    "coerce_dates",
    """WITH p AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS mostly, try_strptime(props, '%Y-%m-%d') AS never FROM events),
       g AS (SELECT avg(CAST(mostly IS NOT NULL AS INTEGER)) > 0.3 AS ok1,
                    avg(CAST(never IS NOT NULL AS INTEGER)) > 0.3 AS ok2 FROM p)
       SELECT strftime(CASE WHEN ok1 THEN mostly END, '%Y-%m-%d') AS mostly_day, count(*) AS n,
              count(CASE WHEN ok2 THEN never END) AS never_parsed
       FROM p, g GROUP BY 1""",
)
def coerce_dates(spark, sf_dir):
    k = F.col("event_id") % 7
    forms = {1: "MM/dd/yyyy", 2: "M/d/yyyy H:mm", 3: "dd-MMM-yyyy", 4: "MMM d, yyyy", 5: "d-M-yyyy", 6: "yyyy-MM-dd"}
    mostly = F.when(k == 0, "n/a")
    for at, form in forms.items():
        mostly = mostly.when(k == at, F.date_format(F.col("ts").cast("timestamp"), form))
    e = table(spark, sf_dir, "events").select(mostly.alias("mostly"), F.col("props").alias("never"))
    parsed = shape.coerce_dates(shape.coerce_dates(e, "mostly"), "never")
    return parsed.groupBy(F.date_format("mostly", "yyyy-MM-dd").alias("mostly_day")).agg(
        F.count(F.lit(1)).alias("n"), F.count("never").alias("never_parsed")
    )


@query(
    "filter_map",
    """SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS first_key FROM orders
       WHERE CAST(o_orderstatus AS VARCHAR) = 'F' AND CAST(o_custkey AS VARCHAR) <> '' GROUP BY 1""",
)
def filter_map(spark, sf_dir):
    wanted = {"o_orderstatus": "F", "o_orderpriority": "", "no_such_column": "x", "o_custkey": None}
    return (
        shape.filter_equal(table(spark, sf_dir, "orders"), wanted)
        .groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))
    )


@query(
    "filter_not_null",
    f"""WITH {EVENTS_DIRTY}
       SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM dirty
       WHERE ts IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL GROUP BY event_type""",
)
def filter_not_null(spark, sf_dir):
    kept = events_dirty(spark, sf_dir).na.drop(subset=["ts", "value", "event_type"])
    return kept.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")
    )


@query(
    "period_tag",
    """WITH t AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'p1'
                              WHEN o_orderdate <= TIMESTAMP '1999-06-30' THEN 'p2' END AS period, o_totalprice FROM orders)
       SELECT period, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM t
       WHERE period IS NOT NULL GROUP BY period""",
)
def period_tag(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tagged = o.withColumn("period", shape.tag_period("o_orderdate", "1999-01-01", "1999-06-30"))
    return tagged.filter("period IS NOT NULL").groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
    )


@query(
    "median_bins",
    """WITH m AS (SELECT quantile_cont(c_acctbal, 0.5) AS med FROM customer)
       SELECT CASE WHEN c_acctbal >= med THEN 'High C Acctbal' ELSE 'Low C Acctbal' END AS bin, c_mktsegment,
              count(*) AS n FROM customer, m GROUP BY ALL""",
)
def median_bins(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_acctbal", "c_mktsegment")
    return shape.high_low_bins(c, "c_acctbal").groupBy("bin", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


ORDERED = "row_number() OVER (ORDER BY o_orderdate, o_orderkey)"


@query(
    "record_index",
    f"""SELECT o_orderkey, 'Sample Record #' || {ORDERED} AS entity FROM orders""",
)
def record_index(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return shape.record_labels(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "entity")


@query(
    "synthetic_dates",
    f"""SELECT o_orderkey, strftime(DATE '2024-01-01' + CAST({ORDERED} - 1 AS INTEGER), '%Y-%m-%d') AS day FROM orders""",
)
def synthetic_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    dated = shape.daily_dates_by_position(o, ["o_orderdate", "o_orderkey"], "2024-01-01")
    return dated.select("o_orderkey", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query(
    "synthetic_recency",
    f"""WITH t AS (SELECT o_orderkey, {ORDERED} AS rn, count(*) OVER () AS n FROM orders)
       SELECT o_orderkey, round(90.0::DOUBLE - (rn - 1) * (89.0::DOUBLE / (n - 1)), 6) AS recency FROM t""",
)
def synthetic_recency(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return shape.linear_recency(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.round("recency", 6).alias("recency"))
