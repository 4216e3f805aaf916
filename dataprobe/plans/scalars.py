"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataprobe.functions.formatting import format_delta, format_metric, format_short, title_case
from dataprobe.functions.ladders import ladder
from dataprobe.functions.numeric import pct_change, whole_days_between
from dataprobe.operators.joining import with_stats
from dataprobe.operators.models import category_codes
from dataprobe.plans.registry import query, table


@query(
    "fn_date",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, strftime(date_trunc('month', min(ts)), '%Y-%m') AS month
       FROM events GROUP BY 1""",
)
def fn_date(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"))
    return e.groupBy(F.date_format("d", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.date_format(F.min("d"), "yyyy-MM").alias("month")
    )


@query(
    "fn_daydiff",
    """WITH m AS (SELECT max(ts) AS last FROM events)
       SELECT event_id, CAST(floor((epoch_us(last) - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS days FROM events, m""",
)
def fn_daydiff(spark, sf_dir):
    e = with_stats(table(spark, sf_dir, "events").select("event_id", "ts"), F.max("ts").alias("last"))
    return e.select("event_id", whole_days_between(F.col("last"), F.col("ts")).alias("days"))


@query(
    "fn_title",
    """WITH t AS (SELECT p_type, replace(p_name, ' ', '_') AS name FROM part)
       SELECT name, list_reduce([upper(x[1]) || lower(x[2:]) for x in string_split(replace(name, '_', ' '), ' ')],
              lambda a, b: a || ' ' || b) AS title, count(*) AS n FROM t GROUP BY name""",
)
def fn_title(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.translate("p_name", " ", "_").alias("name"))
    return p.groupBy("name", title_case(F.col("name")).alias("title")).agg(F.count(F.lit(1)).alias("n"))


_NAMES = ["revenue", "net_price", "discount", "churn_rate", "delivery_delay_days", "score", "quantity", "weight"]
_MONEY = "format('{:,.2f}', abs(v))"
_FORMAT_SQL = f"""CASE
  WHEN regexp_matches(n, 'revenue|sales|profit|spend|cost|price|amount|mrr|arr|\\$') THEN CASE WHEN v < 0 THEN '-' ELSE '' END || {_MONEY}
  WHEN regexp_matches(n, 'rate|pct|percent|discount') THEN
    CASE WHEN v <= 1 THEN printf('%.1f', v * 100) ELSE printf('%.1f', v) END || '%'
  WHEN regexp_matches(n, 'day|delay') THEN printf('%.1f days', v)
  WHEN n = 'score' AND v <= 10 THEN printf('%.1f / 10', v)
  WHEN regexp_matches(n, 'age|time|count|quantity|score') AND v = floor(v) THEN format('{{:,.0f}}', v)
  ELSE format('{{:,.2f}}', v) END"""


@query(
    "fn_format_metric",
    f"""WITH c AS (SELECT o_orderkey, round(o_totalprice / 100, 1) - 1000 AS v,
                     [{", ".join(f"'{n}'" for n in _NAMES)}][CAST(o_orderkey % {len(_NAMES)} + 1 AS INTEGER)] AS n FROM orders)
        SELECT o_orderkey, n AS name, {_FORMAT_SQL} AS text,
               CASE WHEN v < 0 THEN '-' || {_MONEY} WHEN v = floor(v) THEN format('{{:,.0f}}', v) ELSE format('{{:,.2f}}', v) END AS short,
               CASE WHEN v > 0 THEN '+' WHEN v < 0 THEN '-' ELSE '' END || {_MONEY} AS delta FROM c""",
)
def fn_format_metric(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in _NAMES])
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.round(F.col("o_totalprice") / 100, 1) - 1000).alias("v"),
        F.element_at(names, (F.col("o_orderkey") % len(_NAMES) + 1).cast("int")).alias("name"),
    )
    v = F.col("v")
    return o.select(
        "o_orderkey", "name", format_metric(F.col("name"), v).alias("text"),
        format_short(v).alias("short"), format_delta(v).alias("delta"),
    )


@query(
    "fn_pct_change",
    """SELECT o_custkey, round_even((last - first) / greatest(abs(first), 1) * 100, 1) AS pct FROM (
         SELECT o_custkey, min(o_totalprice) AS first, max(o_totalprice) AS last FROM orders GROUP BY o_custkey)""",
)
def fn_pct_change(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b")
    )
    return g.select("o_custkey", pct_change(F.col("a"), F.col("b")).alias("pct"))


@query(
    "fn_string",
    """SELECT doc_id, lower(lang) AS lang, trim(replace(source, 'src', ' ')) AS source,
              contains(lower(text), 'the') AS has_the, len(string_split(text, ' ')) AS parts,
              len(regexp_replace(text, '[?,.]', '', 'g')) AS stripped FROM documents""",
)
def fn_string(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.lower("lang").alias("lang"),
        F.trim(F.replace("source", F.lit("src"), F.lit(" "))).alias("source"),
        F.lower("text").contains("the").alias("has_the"),
        F.size(F.split("text", " ", -1)).cast("long").alias("parts"),
        F.length(F.regexp_replace("text", "[?,.]", "")).cast("long").alias("stripped"),
    )


@query(
    "fn_category_codes",
    """WITH c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM orders))
       SELECT o_orderkey, o_orderpriority, CAST(code AS INTEGER) AS code FROM orders JOIN c ON o_orderpriority = v""",
)
def fn_category_codes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return category_codes(o, ["o_orderpriority"], suffix="_code").select(
        "o_orderkey", "o_orderpriority", F.col("o_orderpriority_code").alias("code")
    )


@query(
    "fn_ladders",
    """SELECT l_returnflag, CASE WHEN l_discount > 0.08 THEN 'High' WHEN l_discount > 0.04 THEN 'Medium' ELSE 'Low' END AS level,
              count(*) AS n FROM lineitem GROUP BY ALL""",
)
def fn_ladders(spark, sf_dir):
    level = ladder(F.col("l_discount"), [(0.08, "High"), (0.04, "Medium")], "Low")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
