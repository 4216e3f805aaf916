"""Recency, frequency and value."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataprobe.functions.numeric import half_even
from dataprobe.operators import rfm
from dataprobe.plans.registry import query, table


def _base(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("order_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )
    return rfm.rfm_base(o, "customer_id", "order_date", "amount")


BASE = """o AS (SELECT o_custkey AS customer_id,
                 CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS order_date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders),
  m AS (SELECT max(order_date) AS last FROM o),
  base AS (SELECT customer_id AS entity, CAST(min(coalesce(date_diff('day', order_date, last), 30)) AS BIGINT) AS recency,
                  count(*) AS frequency, CAST(sum(amount) AS DOUBLE) AS monetary FROM o, m WHERE customer_id IS NOT NULL GROUP BY 1)"""
_BIN = "CAST(greatest(0, least(3, ceil((row_number() OVER (ORDER BY {c}, entity) - 1) * 4.0::DOUBLE / (count(*) OVER () - 1)) - 1)) AS INTEGER)"
SCORES = BASE + f""", sc AS (SELECT *, {_BIN.format(c='recency')} AS rb, {_BIN.format(c='frequency')} AS fb, {_BIN.format(c='monetary')} AS mb FROM base),
  scores AS (SELECT entity, recency, frequency, monetary, 3 - rb AS r_score, fb + 1 AS f_score, mb + 1 AS m_score, mb AS quartile,
             round_even((3 - rb) * 0.3::DOUBLE + (fb + 1) * 0.3::DOUBLE + (mb + 1) * 0.4::DOUBLE, 2) AS rfm_score FROM sc),
  names AS (SELECT * FROM (VALUES (3, 'Champions', 'Reward and protect', 1), (2, 'Loyal Advocates', 'Grow and cross-sell', 2),
             (1, 'At-Risk Accounts', 'Win back now', 3), (0, 'Hibernating', 'Reactivate at low cost', 4)) t(quartile, segment, action, place))"""


@query("rfm_base", f"WITH {BASE} SELECT entity, recency, frequency, monetary FROM base")
def rfm_base(spark, sf_dir):
    return _base(spark, sf_dir).drop("has_dates")


@query("rfm_scores", f"WITH {SCORES} SELECT entity, r_score, f_score, m_score, quartile, rfm_score FROM scores")
def rfm_scores(spark, sf_dir):
    return rfm.rfm_scores(_base(spark, sf_dir)).select("entity", "r_score", "f_score", "m_score", "quartile", "rfm_score")


@query(
    "rfm_segments",
    f"""WITH {SCORES}, g AS (SELECT quartile, count(*) AS n, avg(recency) AS r, avg(monetary) AS m FROM scores GROUP BY 1)
        SELECT segment, coalesce(n, 0) AS entities, round_even(coalesce(n, 0) / (SELECT count(*) FROM scores) * 100, 1) AS percentage,
               round_even(coalesce(r, 0), 1) AS avg_recency_days, round_even(coalesce(m, 0), 2) AS avg_monetary, action, place
        FROM names LEFT JOIN g ON names.quartile = g.quartile""",
)
def rfm_segments(spark, sf_dir):
    return rfm.rfm_segments(rfm.rfm_scores(_base(spark, sf_dir)))


def _part_base(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type", F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    return rfm.rfm_base(part, rfm.entity_column(part), None, "price")


PART = """d AS (SELECT count(DISTINCT p_name) AS a, count(DISTINCT p_brand) AS b, count(DISTINCT p_type) AS c FROM part),
  o AS (SELECT CASE WHEN a BETWEEN 3 AND 1000 THEN p_name WHEN b BETWEEN 3 AND 1000 THEN p_brand WHEN c BETWEEN 3 AND 1000 THEN p_type END AS entity,
               CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM part, d),
  base AS (SELECT entity, count(*) AS frequency, CAST(sum(price) AS DOUBLE) / count(*) AS monetary FROM o WHERE entity IS NOT NULL GROUP BY 1)"""


@query("rfm_fallback_entity", f"WITH {PART} SELECT entity, frequency, round(monetary, 6) AS monetary FROM base")
def rfm_fallback_entity(spark, sf_dir):
    return _part_base(spark, sf_dir).select("entity", "frequency", F.round("monetary", 6).alias("monetary"))


@query(
    "rfm_domain_tiers",
    f"""WITH {PART}, sc AS (SELECT *, {_BIN.format(c='monetary')} AS quartile FROM base)
        SELECT entity, CASE quartile WHEN 3 THEN 'Optimal Tier (High Range)' WHEN 2 THEN 'Balanced Baseline Tier (Standard)'
               WHEN 1 THEN 'Moderate Deficit Tier (Sub-Optimal)' ELSE 'Critical Deficit Tier (Low Range)' END AS tier,
               CASE quartile WHEN 3 THEN 'High Care Priority (Intensive Tier)' WHEN 2 THEN 'Elevated Monitoring Tier'
               WHEN 1 THEN 'Moderate Risk Tier' ELSE 'Low Risk / Stable Tier' END AS care FROM sc""",
)
def rfm_domain_tiers(spark, sf_dir):
    scores = rfm.rfm_scores(_part_base(spark, sf_dir))
    tiers = rfm.with_segments(scores, "agriculture").select("entity", "quartile", F.col("segment").alias("tier"))
    return rfm.with_segments(tiers, "healthcare").select("entity", "tier", F.col("segment").alias("care"))


@query(
    "rfm_top",
    f"""WITH {SCORES} SELECT entity, segment, frequency, round_even(monetary, 2) AS total_value, CAST(recency AS DOUBLE) AS recency_days
        FROM scores JOIN names ON scores.quartile = names.quartile ORDER BY monetary DESC, entity LIMIT 8""",
)
def rfm_top(spark, sf_dir):
    return rfm.rfm_top(rfm.rfm_scores(_base(spark, sf_dir)))


@query(
    "rfm_retention",
    f"WITH {SCORES} SELECT count(*) AS entities, round_even(avg(CAST(quartile IN (2, 3) AS INTEGER)) * 100, 1) AS retention_rate FROM scores",
)
def rfm_retention(spark, sf_dir):
    return rfm.rfm_retention(rfm.rfm_scores(_base(spark, sf_dir)))


@query("rfm_kmeans")
def rfm_kmeans(spark, sf_dir):
    return rfm.rfm_kmeans(_base(spark, sf_dir)).groupBy("segment").agg(
        F.count(F.lit(1)).alias("entities"), half_even(F.avg("recency"), 1).alias("avg_recency"),
        half_even(F.avg("frequency"), 1).alias("avg_frequency"), half_even(F.avg("monetary"), 2).alias("avg_monetary"),
    )
