"""Labels, features, splits, tree models and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataprobe.operators import metrics, models
from dataprobe.plans.business import ledger
from dataprobe.plans.inputs import EVENTS_DIRTY, SCORED, events_dirty, sales, scored_documents
from dataprobe.plans.registry import query, table
from dataprobe.scratch import materialise


def _label(name, source, column, rule, note):
    @query(name, f"SELECT CAST({rule} AS INTEGER) AS label, {note} AS meaning, count(*) AS n FROM {source} GROUP BY ALL")
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        found = models.binary_label(df, column)
        return df.groupBy(found.expr.alias("label"), F.lit(found.description).alias("meaning")).agg(F.count(F.lit(1)).alias("n"))


_label("label_binary", "labels", "quality", "quality", "'Quality'")
_label("label_posword", "orders", "o_orderpriority", "lower(o_orderpriority) = '1-urgent'", "'O Orderpriority = 1-urgent'")
_RARE = "(SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*), 1 DESC LIMIT 1)"
_label("label_minority", "orders", "o_orderstatus", f"o_orderstatus = {_RARE}", f"'O Orderstatus = ' || {_RARE}")
_LOSSES = "(SELECT count(*) FILTER (c_acctbal < 0) >= 20 FROM customer)"
_label(
    "label_loss", "customer", "c_acctbal",
    f"CASE WHEN {_LOSSES} THEN c_acctbal <= 0 ELSE c_acctbal <= (SELECT quantile_cont(c_acctbal, 0.25) FROM customer) END",
    f"CASE WHEN {_LOSSES} THEN 'Unprofitable / Loss Risk (C Acctbal <= 0)' ELSE 'Low C Acctbal Risk' END",
)
_label(
    "label_quartile", "orders", "o_totalprice", "o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.25) FROM orders)",
    "'Low O Totalprice Risk'",
)


def _leaky(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.col("l_discount").alias("discount"),
        F.col("l_orderkey").alias("order_id"), F.col("l_returnflag").alias("flag"), F.lit(1.0).alias("fixed"),
        F.col("l_linenumber").alias("line_code"),
    )


@query(
    "leakage_filter",
    """WITH t AS (SELECT l_extendedprice AS price, l_quantity AS quantity, l_extendedprice * (1 - l_discount) AS net, l_discount AS discount,
                  l_orderkey AS order_id, l_returnflag AS flag, l_linenumber AS line_code FROM lineitem),
       f AS (SELECT 'quantity' AS feature, count(DISTINCT quantity) AS distinct_count, corr(quantity, price) AS r, false AS id_like FROM t
             UNION ALL SELECT 'net', count(DISTINCT net), corr(net, price), false FROM t
             UNION ALL SELECT 'discount', count(DISTINCT discount), corr(discount, price), false FROM t
             UNION ALL SELECT 'order_id', count(DISTINCT order_id), corr(order_id, price), true FROM t
             UNION ALL SELECT 'flag', count(DISTINCT flag), NULL, false FROM t
             UNION ALL SELECT 'fixed', 1, NULL, false FROM t
             UNION ALL SELECT 'line_code', count(DISTINCT line_code), corr(line_code, price), true FROM t)
       SELECT feature, distinct_count, round(r, 4) AS correlation, CASE WHEN id_like THEN 'identifier' WHEN distinct_count <= 1 THEN 'constant'
              WHEN distinct_count >= (SELECT count(*) FROM t) THEN 'all distinct' WHEN abs(r) > 0.9 THEN 'collinear' ELSE 'kept' END AS verdict
       FROM (SELECT feature, distinct_count, r, id_like FROM f GROUP BY ALL)""",
)
def leakage_filter(spark, sf_dir):
    r = models.leakage_report(_leaky(spark, sf_dir), "price")
    return r.withColumn("correlation", F.round("correlation", 4))


@query(
    "feature_matrix",
    f"""WITH {EVENTS_DIRTY}, m AS (SELECT quantile_cont(value, 0.5) AS med FROM dirty),
        lv AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(channel, 'Unknown') AS v FROM dirty))
        SELECT event_id, coalesce(value, med) AS x_value, CAST(user_id AS DOUBLE) AS x_user_id, CAST(code AS DOUBLE) AS x_channel
        FROM dirty, m, lv WHERE coalesce(channel, 'Unknown') = v""",
)
def feature_matrix(spark, sf_dir):
    frame, _ = models.feature_frame(events_dirty(spark, sf_dir), ["value", "user_id", "channel"], ["event_id"])
    return frame


@query(
    "stratified_split",
    """SELECT o_orderstatus, t.is_test, CASE WHEN t.is_test THEN CAST(ceil(n * 0.25::DOUBLE) AS BIGINT) ELSE n - CAST(ceil(n * 0.25::DOUBLE) AS BIGINT) END AS rows
       FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), (VALUES (true), (false)) t(is_test)""",
)
def stratified_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    s = models.stratified_split(o, "o_orderstatus", ["o_orderkey"], 0.25)
    return s.groupBy("o_orderstatus", "is_test").agg(F.count(F.lit(1)).alias("rows"))


def _risk(spark, sf_dir):
    df = ledger(spark, sf_dir)
    return models.risk_model(df, "order_cancelled", ["order_id", "customer_id", "revenue"])


@query("churn_model")
def churn_model(spark, sf_dir):
    return models.risk_contributions(_risk(spark, sf_dir))


@query("churn_model_metrics")
def churn_model_metrics(spark, sf_dir):
    scored = materialise(_risk(spark, sf_dir).scored.select("label", "prediction", "score"), "scored")
    return metrics.binary_metrics(scored).crossJoin(F.broadcast(metrics.roc_auc(scored)))


@query("confusion_matrix", f"WITH {SCORED} SELECT label, prediction, count(*) AS count FROM scored GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(scored_documents(spark, sf_dir))


@query(
    "classification_metrics",
    f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
          count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM scored)
        SELECT tp, fp, fn, tn, round_even((tp + tn) / (tp + fp + fn + tn) * 100, 1) AS accuracy, round_even(coalesce(tp / nullif(tp + fp, 0), 0) * 100, 1) AS precision,
               round_even(coalesce(tp / nullif(tp + fn, 0), 0) * 100, 1) AS recall, round_even(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * 100, 1) AS f1 FROM c""",
)
def classification_metrics(spark, sf_dir):
    return metrics.binary_metrics(scored_documents(spark, sf_dir))


@query(
    "classification_metrics_weighted",
    """WITH s AS (SELECT o_orderpriority AS label, CASE WHEN o_totalprice > 300000 THEN '1-URGENT' WHEN o_totalprice > 150000 THEN '3-MEDIUM' ELSE o_orderpriority END AS prediction FROM orders),
       k AS (SELECT DISTINCT label AS c FROM s),
       p AS (SELECT c, count(*) FILTER (label = c AND prediction = c) AS tp, count(*) FILTER (label = c) AS sup, count(*) FILTER (prediction = c) AS g FROM s, k GROUP BY c)
       SELECT round_even(sum(tp) / sum(sup) * 100, 1) AS accuracy, round_even(sum(coalesce(tp / nullif(g, 0), 0) * sup) / sum(sup) * 100, 1) AS precision,
              round_even(sum(coalesce(tp / nullif(sup, 0), 0) * sup) / sum(sup) * 100, 1) AS recall,
              round_even(sum(coalesce(2 * tp / nullif(sup + g, 0), 0) * sup) / sum(sup) * 100, 1) AS f1 FROM p""",
)
def classification_metrics_weighted(spark, sf_dir):
    price = F.col("o_totalprice")
    s = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("label"),
        F.when(price > 300000, "1-URGENT").when(price > 150000, "3-MEDIUM").otherwise(F.col("o_orderpriority")).alias("prediction"),
    )
    return metrics.weighted_metrics(s)


@query(
    "roc_auc",
    f"""WITH {SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM scored),
        n AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM scored)
        SELECT round_even((sum(rk) FILTER (label = 1) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(q)), 3) AS roc_auc FROM r, n""",
)
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored_documents(spark, sf_dir))


@query(
    "r2_score",
    """WITH t AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
       SELECT round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM t""",
)
def r2_score(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    return metrics.r2_score(li).select(F.round("r2", 6).alias("r2"))


_FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query(
    "driver_direction",
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r FROM lineitem" for c in _FEATURES)
    + """) SELECT feature, round(r, 6) AS correlation, CASE WHEN r > 0.05 THEN 'Positive (Higher values increase target)'
         WHEN r < -0.05 THEN 'Negative (Higher values decrease target)' ELSE 'Non-linear Complex Influence' END AS direction FROM c""",
)
def driver_direction(spark, sf_dir):
    d = models.driver_direction(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), _FEATURES)
    return d.withColumn("correlation", F.round("correlation", 6))


@query("target_drivers")
def target_drivers(spark, sf_dir):
    s = sales(spark, sf_dir).select("order_id", "quantity", "discount", F.col("revenue").cast("double").alias("revenue"))
    drivers, _ = models.target_drivers(s, "revenue", key=["order_id", "quantity", "revenue"])
    return drivers


@query("target_driver_scores")
def target_driver_scores(spark, sf_dir):
    s = sales(spark, sf_dir).select("order_id", "quantity", "discount", F.col("revenue").cast("double").alias("revenue"))
    _, scores = models.target_drivers(s, "revenue", key=["order_id", "quantity", "revenue"])
    return scores
