"""Key figures, alerts and chart rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataprobe.functions.numeric import half_even
from dataprobe.operators import charts, kpi
from dataprobe.operators.aggregates import value_counts
from dataprobe.operators.dashboard import dashboard
from dataprobe.plans.inputs import SALES, sales
from dataprobe.plans.registry import query, table


def day():
    return F.date_format("date", "yyyy-MM-dd").alias("date")



def ledger(spark, sf_dir):
    """Sales with a falling revenue and a rising cancellation flag from 1999 on."""
    s = sales(spark, sf_dir)
    late = F.col("order_date") >= F.lit("1999-01-01").cast("date")
    half = F.lit("0.5").cast("decimal(2,1)")
    return s.withColumn(
        "revenue", F.when(late, F.col("revenue") * half).otherwise(F.col("revenue")).cast("decimal(18,4)")
    ).withColumn("order_cancelled", ((F.col("quantity") >= 45) | (late & (F.col("quantity") >= 35))).cast("int"))


LEDGER = SALES + """, ledger AS (SELECT order_id, order_date, customer_id, region, nation, segment, priority, quantity, discount,
  CAST(CASE WHEN order_date >= DATE '1999-01-01' THEN revenue * CAST('0.5' AS DECIMAL(2,1)) ELSE revenue END AS DECIMAL(18,4)) AS revenue,
  CAST(quantity >= 45 OR (order_date >= DATE '1999-01-01' AND quantity >= 35) AS INTEGER) AS order_cancelled FROM sales)"""


def kpi_sql(src: str) -> str:
    return f"""cut AS (SELECT quantile_cont(epoch_us(order_date::TIMESTAMP)::DOUBLE, 0.5) AS c FROM {src}),
  t AS (SELECT *, epoch_us(order_date::TIMESTAMP) < c AS p1 FROM {src}, cut),
  k AS (SELECT count(*) AS n, count(*) FILTER (p1) AS n1, count(*) FILTER (NOT p1) AS n2,
     sum(revenue)::DOUBLE AS m, (sum(revenue) FILTER (p1))::DOUBLE AS m1, (sum(revenue) FILTER (NOT p1))::DOUBLE AS m2,
     avg(discount) AS e, avg(discount) FILTER (p1) AS e1, avg(discount) FILTER (NOT p1) AS e2,
     avg(order_cancelled) AS r, avg(order_cancelled) FILTER (p1) AS r1, avg(order_cancelled) FILTER (NOT p1) AS r2 FROM t),
  kpis AS (
     SELECT 'total_records' AS kpi, 'Total Records' AS title, format('{{:,}}', n) AS value, n::DOUBLE AS raw_value,
            CASE WHEN n1 > 0 THEN round_even((n2 - n1)::DOUBLE / greatest(abs(n1), 1) * 100, 1) END AS delta_percent, true AS rising FROM k
     UNION ALL SELECT 'primary_monetary', 'Total Revenue', format('{{:,.2f}}', m), round_even(m, 2), round_even((m2 - m1) / greatest(abs(m1), 1) * 100, 1), true FROM k
     UNION ALL SELECT 'primary_efficiency', 'Average Discount', printf('%.1f', e * 100) || '%', round_even(e, 4), round_even((e2 - e1) / greatest(abs(e1), 0.001) * 100, 1), true FROM k
     UNION ALL SELECT 'critical_risk', 'Order Cancelled Rate', printf('%.1f', r * 100) || '%', round_even(r, 3), round_even((r2 - r1) / greatest(abs(r1), 0.001) * 100, 1), false FROM k),
  kpi_rows AS (SELECT kpi, title, value, raw_value, delta_percent,
     coalesce(CASE WHEN rising THEN delta_percent >= 0 ELSE delta_percent <= 0 END, true) AS is_positive FROM kpis)"""


KPIS = f"WITH {LEDGER}, {kpi_sql('ledger')}"


def _kpi(name, which):
    where = f" WHERE kpi = '{which}'" if which else ""

    @query(name, f"{KPIS} SELECT * FROM kpi_rows{where}")
    def run(spark, sf_dir):
        k = kpi.kpi_table_by_role(ledger(spark, sf_dir), "order_date")
        return k.filter(F.col("kpi") == which) if which else k


_kpi("kpi_records", "total_records")
_kpi("kpi_monetary", "primary_monetary")
_kpi("kpi_efficiency", "primary_efficiency")
_kpi("kpi_risk", "critical_risk")
_kpi("kpi_table", None)


@query(
    "kpi_alerts",
    f"""{KPIS} SELECT kpi, 'danger' AS level, 'Operational Alert: Surge in ' || title AS title, delta_percent FROM kpi_rows
        WHERE kpi = 'critical_risk' AND delta_percent > 20
        UNION ALL SELECT kpi, 'warning', 'Performance Drop: ' || title || ' Down ' || printf('%.1f', abs(delta_percent)) || '%', delta_percent
        FROM kpi_rows WHERE kpi IN ('primary_monetary', 'primary_efficiency') AND delta_percent < -10""",
)
def kpi_alerts(spark, sf_dir):
    return kpi.alerts(kpi.kpi_table_by_role(ledger(spark, sf_dir), "order_date"))


SOUTH = LEDGER + ", asia AS (SELECT * FROM ledger WHERE region = 'ASIA')"


@query("dashboard_filtered_kpis", f"WITH {SOUTH}, {kpi_sql('asia')} SELECT * FROM kpi_rows")
def dashboard_filtered_kpis(spark, sf_dir):
    parts = dashboard(
        ledger(spark, sf_dir), ["order_date", "order_id", "revenue"], {"region": "ASIA", "unknown": "x"}, "order_date", ["region", "segment"]
    )
    return parts["kpis"]


# --------------------------------------------------------------------- charts

TREND = f"""WITH {SALES}, d AS (SELECT order_date AS date, CAST(sum(revenue) AS DOUBLE) AS value FROM sales GROUP BY 1
            ORDER BY date DESC LIMIT 60)"""


@query("chart_trend", f"{TREND} SELECT strftime(date, '%Y-%m-%d') AS date, value FROM d")
def chart_trend(spark, sf_dir):
    return charts.trend(sales(spark, sf_dir), "order_date", "revenue").select(day(), "value")


@query(
    "chart_trend_takeaway",
    f"""{TREND}, e AS (SELECT arg_min(value, date) AS first_value, arg_max(value, date) AS last_value FROM d),
        p AS (SELECT *, round_even((last_value - first_value) / greatest(abs(first_value), 1) * 100, 1) AS change_percent FROM e)
        SELECT *, CASE WHEN change_percent >= 0 THEN 'increased' ELSE 'declined' END AS direction FROM p""",
)
def chart_trend_takeaway(spark, sf_dir):
    return charts.trend_takeaway(charts.trend(sales(spark, sf_dir), "order_date", "revenue"))


def _top_sql(dim, k):
    return f"""WITH {SALES}, s AS (SELECT {dim} AS label, CAST(sum(revenue) AS DOUBLE) AS value FROM sales GROUP BY 1
               ORDER BY value DESC, label LIMIT {k})"""


@query(
    "chart_breakdown",
    f"""{_top_sql('nation', 10)} SELECT label, value FROM s""",
)
def chart_breakdown(spark, sf_dir):
    return charts.ranked_sum(sales(spark, sf_dir), "nation", "revenue", 10)


@query(
    "chart_breakdown_takeaway",
    f"""{_top_sql('nation', 10)}, r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rn, sum(value) OVER () AS t, count(*) OVER () AS n FROM s)
        SELECT max(label) FILTER (rn = 1) AS leader, max(CASE WHEN value = floor(value) THEN format('{{:,.0f}}', value) ELSE format('{{:,.2f}}', value) END) FILTER (rn = 1) AS leader_value,
               round_even(max(value / t * 100) FILTER (rn = 1), 1) AS leader_share, max(label) FILTER (rn = n) AS laggard,
               max(CASE WHEN value = floor(value) THEN format('{{:,.0f}}', value) ELSE format('{{:,.2f}}', value) END) FILTER (rn = n) AS laggard_value FROM r""",
)
def chart_breakdown_takeaway(spark, sf_dir):
    return charts.breakdown_takeaway(charts.ranked_sum(sales(spark, sf_dir), "nation", "revenue", 10))


@query(
    "chart_share",
    f"{_top_sql('segment', 6)} SELECT label, value, round_even(value / sum(value) OVER () * 100, 1) AS share FROM s",
)
def chart_share(spark, sf_dir):
    return charts.share(sales(spark, sf_dir), "segment", "revenue", 6)


@query(
    "chart_scatter",
    """SELECT p_size AS x, p_retailprice AS y FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL ORDER BY p_partkey LIMIT 80""",
)
def chart_scatter(spark, sf_dir):
    return charts.scatter(table(spark, sf_dir, "part"), "p_size", "p_retailprice", ["p_partkey"])


@query(
    "chart_risk",
    f"""WITH {SALES} SELECT nation AS label, round_even(avg(discount), 2) AS value FROM sales GROUP BY 1 ORDER BY value DESC, label LIMIT 8""",
)
def chart_risk(spark, sf_dir):
    return charts.risk_by(sales(spark, sf_dir), "nation", "discount", 8)


@query(
    "chart_entities",
    """SELECT p_name AS label, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name ORDER BY value DESC, label LIMIT 10""",
)
def chart_entities(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return charts.ranked_sum(li.join(p, li.l_partkey == p.p_partkey), "p_name", "price", 10)


@query(
    "chart_fallback_counts",
    "SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1 ORDER BY count DESC, value LIMIT 8",
)
def chart_fallback_counts(spark, sf_dir):
    return value_counts(table(spark, sf_dir, "orders"), "o_orderpriority", 8)


@query(
    "chart_fallback_values",
    """WITH t AS (SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS category, o_totalprice AS value FROM orders)
       SELECT category, value, (SELECT round_even(avg(value), 2) FROM t) AS mean FROM t WHERE category <= 30""",
)
def chart_fallback_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    mean = o.agg(half_even(F.avg("o_totalprice"), 2).alias("mean"))
    return charts.value_list(o, "o_totalprice", ["o_orderkey"]).crossJoin(F.broadcast(mean))


@query(
    "custom_chart_raw",
    """SELECT o_orderpriority AS label, o_totalprice AS value FROM orders
       WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL ORDER BY o_orderdate, o_orderkey LIMIT 40""",
)
def custom_chart_raw(spark, sf_dir):
    return charts.custom(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", order_by=["o_orderdate", "o_orderkey"])


@query(
    "custom_chart_dist",
    "SELECT p_brand AS label, count(*) AS value FROM part GROUP BY p_brand ORDER BY value DESC, label LIMIT 20",
)
def custom_chart_dist(spark, sf_dir):
    return charts.custom(table(spark, sf_dir, "part"), "p_brand")


@query(
    "custom_chart_agg",
    " UNION ALL ".join(
        f"""(SELECT '{a}' AS aggregation, p_brand AS label, CAST({e} AS DOUBLE) AS value FROM part GROUP BY p_brand ORDER BY value DESC, label LIMIT 20)"""
        for a, e in (
            ("sum", "sum(CAST(p_retailprice AS DECIMAL(18,2)))"), ("max", "max(p_retailprice)"), ("min", "min(p_retailprice)"), ("count", "count(*)"),
        )
    ),
)
def custom_chart_agg(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    out = None
    for a in ("sum", "max", "min", "count"):
        part = charts.custom(p, "p_brand", "price", a).select(F.lit(a).alias("aggregation"), "label", F.col("value").cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
