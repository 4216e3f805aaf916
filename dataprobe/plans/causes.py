"""Root cause and report."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataprobe.operators import report, rootcause
from dataprobe.plans.business import LEDGER, ledger
from dataprobe.plans.inputs import SALES_PLANTED, sales_planted
from dataprobe.plans.profiling import facts_sql, report_sql
from dataprobe.plans.registry import query, table
from dataprobe.scratch import materialise

START, END = "1999-01-01", "1999-06-30"
DIMS = ["region", "segment", "priority"]

TOTALS = f"""{SALES_PLANTED}, t AS (SELECT *, order_date < DATE '{START}' AS p1, order_date BETWEEN DATE '{START}' AND DATE '{END}' AS p2 FROM planted),
  days AS (SELECT greatest(1, count(DISTINCT order_date) FILTER (p1)) AS d1, greatest(1, count(DISTINCT order_date) FILTER (p2)) AS d2,
           coalesce((sum(revenue) FILTER (p1))::DOUBLE, 0) AS s1, coalesce((sum(revenue) FILTER (p2))::DOUBLE, 0) AS s2 FROM t),
  totals AS (SELECT d1 AS p1_days, d2 AS p2_days, s1 / d1 AS p1_daily, s2 / d2 AS p2_daily, s2 / d2 - s1 / d1 AS delta,
             round_even((s2 / d2 - s1 / d1) / greatest(abs(s1 / d1), 1) * 100, 1) AS pct_change FROM days)"""


def _items(dims, src="t", value="revenue"):
    parts = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS item, {value} AS revenue, p1, p2 FROM {src}" for d in dims)
    return f"""l AS ({parts}),
  g AS (SELECT dimension, item, coalesce((sum(revenue) FILTER (p1))::DOUBLE, 0) AS s1, coalesce((sum(revenue) FILTER (p2))::DOUBLE, 0) AS s2
        FROM l WHERE item IS NOT NULL AND (p1 OR p2) GROUP BY ALL),
  dd AS (SELECT dimension, item, s1 / d1 AS a, s2 / d2 AS b, s2 / d2 - s1 / d1 AS delta FROM g, (SELECT d1, d2 FROM days)),
  items AS (SELECT dimension, item, a AS p1_daily, b AS p2_daily, delta, round_even((b - a) / CASE WHEN a = 0 THEN 1 ELSE a END * 100, 1) AS pct_change,
            CASE WHEN delta < 0 THEN round_even(delta / (sum(delta) FILTER (delta < 0) OVER (PARTITION BY dimension)) * 100, 1) ELSE 0 END::DOUBLE AS contribution FROM dd)"""


def _tagged(spark, sf_dir):
    return rootcause.with_periods(sales_planted(spark, sf_dir), "order_date", ["order_date", "order_id"], START, END)


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 4) for c in cols})


@query(
    "rootcause_totals",
    f"WITH {TOTALS} SELECT p1_days, p2_days, round(p1_daily, 4) AS p1_daily, round(p2_daily, 4) AS p2_daily, round(delta, 4) AS delta, pct_change FROM totals",
)
def rootcause_totals(spark, sf_dir):
    return _round(rootcause.period_totals(_tagged(spark, sf_dir), "order_date", "revenue"), "p1_daily", "p2_daily", "delta")


_ITEM_COLUMNS = "dimension, item, round(p1_daily, 4) AS p1_daily, round(p2_daily, 4) AS p2_daily, round(delta, 4) AS delta, pct_change, contribution"


@query("rootcause_dimensions", f"WITH {TOTALS}, {_items(DIMS)} SELECT {_ITEM_COLUMNS} FROM items")
def rootcause_dimensions(spark, sf_dir):
    t = _tagged(spark, sf_dir)
    totals = materialise(rootcause.period_totals(t, "order_date", "revenue"), "totals")
    return _round(rootcause.decompose(t, totals, "revenue", DIMS), "p1_daily", "p2_daily", "delta")


# the default dimensions: all text columns with 2 to 30 values
_DEFAULT = ["region", "nation", "segment", "priority"]


@query(
    "rootcause_top_driver",
    f"WITH {TOTALS}, {_items(_DEFAULT)} SELECT {_ITEM_COLUMNS} FROM items WHERE delta <> 0 ORDER BY abs(delta) DESC, dimension, item LIMIT 1",
)
def rootcause_top_driver(spark, sf_dir):
    parts = rootcause.investigate(sales_planted(spark, sf_dir), "revenue", "order_date", ["order_date", "order_id"], START, END)
    return _round(parts["top_driver"], "p1_daily", "p2_daily", "delta")


@query(
    "rootcause_narrative",
    f"""WITH {TOTALS}, {_items(_DEFAULT)}, top AS (SELECT * FROM items WHERE delta <> 0 ORDER BY abs(delta) DESC, dimension, item LIMIT 1)
        SELECT 'Revenue ' || CASE WHEN totals.delta < 0 THEN 'dropped' ELSE 'increased' END || ' by ' || printf('%.1f', abs(totals.pct_change)) || '% (daily average from '
               || format('{{:,.2f}}', totals.p1_daily) || ' to ' || format('{{:,.2f}}', totals.p2_daily) || ').' AS what_happened,
               CASE WHEN totals.delta < 0 THEN 'Main decline: ''' ELSE 'Main growth: ''' END || item || ''' in ' || upper(dimension[1]) || dimension[2:]
               || ' changed by ' || CASE WHEN top.pct_change >= 0 THEN '+' ELSE '' END || printf('%.1f', top.pct_change) || '%.' AS why_it_happened
        FROM totals, top""",
)
def rootcause_narrative(spark, sf_dir):
    return rootcause.investigate(sales_planted(spark, sf_dir), "revenue", "order_date", ["order_date", "order_id"], START, END)["narrative"]


@query(
    "rootcause_numeric_fallback",
    f"""WITH {TOTALS}, med AS (SELECT quantile_cont(quantity, 0.5) AS mq, quantile_cont(discount, 0.5) AS md FROM t),
        best AS (SELECT CASE WHEN abs(corr(revenue::DOUBLE, quantity)) >= abs(corr(revenue::DOUBLE, discount)) THEN 'quantity' ELSE 'discount' END AS c FROM t),
        b AS (SELECT CASE WHEN quantity >= mq THEN 'High Quantity' ELSE 'Low Quantity' END AS quantity,
                     CASE WHEN discount >= md THEN 'High Discount' ELSE 'Low Discount' END AS discount, revenue, p1, p2 FROM t, med),
        {_items(['quantity', 'discount'], 'b')}
        SELECT {_ITEM_COLUMNS} FROM items WHERE dimension = (SELECT c FROM best)""",
)
def rootcause_numeric_fallback(spark, sf_dir):
    t = _tagged(spark, sf_dir).select("order_id", "order_date", "quantity", "discount", "revenue", "in_p1", "in_p2")
    totals = materialise(rootcause.period_totals(t, "order_date", "revenue"), "totals")
    return _round(rootcause.numeric_fallback(t, totals, "revenue"), "p1_daily", "p2_daily", "delta")


_SHIFT = "SELECT '{c}' AS metric, avg({c}) FILTER (p1) AS a, avg({c}) FILTER (p2) AS b FROM x"


@query(
    "rootcause_shifts",
    f"""WITH {LEDGER}, x AS (SELECT quantity, discount, order_cancelled, CAST(revenue AS DOUBLE) AS revenue, order_date < DATE '{START}' AS p1,
                             order_date BETWEEN DATE '{START}' AND DATE '{END}' AS p2 FROM ledger),
        m AS ({" UNION ALL ".join(_SHIFT.format(c=c) for c in ("quantity", "discount", "order_cancelled", "revenue"))}),
        c AS (SELECT metric, a, b, round_even((b - a) / greatest(abs(a), 0.001) * 100, 1) AS pct_change FROM m)
        SELECT metric, round_even(a, 2) AS p1_mean, round_even(b, 2) AS p2_mean, pct_change, CASE WHEN pct_change > 0 THEN 'Increased' ELSE 'Decreased' END AS direction
        FROM c WHERE abs(pct_change) >= 10""",
)
def rootcause_shifts(spark, sf_dir):
    t = rootcause.with_periods(ledger(spark, sf_dir), "order_date", ["order_date", "order_id"], START, END)
    return rootcause.shifts(t, ["quantity", "discount", "order_cancelled", "revenue"])


@query("rootcause_drivers")
def rootcause_drivers(spark, sf_dir):
    s = sales_planted(spark, sf_dir).drop("order_date")
    return rootcause.regression_drivers(s, "revenue")


# ----------------------------------------------------------------- incidence

@query(
    "incidence_rate",
    """WITH t AS (SELECT o_orderstatus AS v FROM orders), p AS (SELECT DISTINCT v FROM t ORDER BY v LIMIT 1 OFFSET 1)
       SELECT any_value(p.v) AS positive_class, count(*) AS rows, count(*) FILTER (t.v = p.v) AS positives,
              round_even(count(*) FILTER (t.v = p.v) / count(*) * 100, 1) AS rate FROM t, p""",
)
def incidence_rate(spark, sf_dir):
    return rootcause.incidence(table(spark, sf_dir, "orders"), "o_orderstatus")


_CONTRAST = ["quantity", "discount", "revenue"]


@query(
    "class_contrast",
    f"WITH {LEDGER}, c AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}::DOUBLE) FILTER (order_cancelled = 1) AS a, avg({c}::DOUBLE) FILTER (order_cancelled = 0) AS b FROM ledger"
        for c in _CONTRAST
    )
    + """) SELECT feature, round_even(a, 4) AS positive_mean, round_even(b, 4) AS other_mean, round_even((a - b) / greatest(abs(b), 0.001) * 100, 1) AS difference_percent,
           CASE WHEN round_even((a - b) / greatest(abs(b), 0.001) * 100, 1) > 0 THEN 'Elevated' ELSE 'Suppressed' END AS direction FROM c""",
)
def class_contrast(spark, sf_dir):
    return rootcause.class_contrast(ledger(spark, sf_dir), "order_cancelled", "1", _CONTRAST)


@query(
    "incidence_by_dimension",
    f"""WITH {LEDGER}, l AS (SELECT 'region' AS dimension, region AS item, order_cancelled AS y FROM ledger UNION ALL SELECT 'segment', segment, order_cancelled FROM ledger)
        SELECT dimension, item, count(*) AS rows, count(*) FILTER (y = 1) AS positives, round_even(count(*) FILTER (y = 1) / count(*) * 100, 1) AS rate
        FROM l WHERE item IS NOT NULL GROUP BY ALL""",
)
def incidence_by_dimension(spark, sf_dir):
    return rootcause.incidence_by(ledger(spark, sf_dir), "order_cancelled", "1", ["region", "segment"])


def _classify(spark, sf_dir):
    return rootcause.classifier(ledger(spark, sf_dir).drop("order_date"), "order_cancelled")


@query("rootcause_classifier")
def rootcause_classifier(spark, sf_dir):
    return _classify(spark, sf_dir)[0]


@query("rootcause_classifier_features")
def rootcause_classifier_features(spark, sf_dir):
    return _classify(spark, sf_dir)[1]


# --------------------------------------------------------------------- report

_SALE_TYPES = {
    "order_id": "integer", "order_date": "datetime", "customer_id": "integer", "region": "string", "nation": "string", "segment": "string",
    "priority": "string", "quantity": "float", "discount": "float", "revenue": "float",
}
_SALE_NUMBERS = ["order_id", "customer_id", "quantity", "discount", "revenue"]


@query(
    "report_findings",
    f"""WITH {TOTALS}, {_items(_DEFAULT)}, top AS (SELECT * FROM items WHERE delta <> 0 ORDER BY abs(delta) DESC, dimension, item LIMIT 1),
        {facts_sql("planted", _SALE_TYPES)}, {report_sql("planted", _SALE_TYPES, _SALE_NUMBERS)}
        SELECT 1 AS place, 'Dataset ''sales'': ' || format('{{:,}}', total_rows) || ' rows, 10 columns.' AS finding FROM report
        UNION ALL SELECT 2, 'Data quality score is ' || quality_score || ' of 100.' FROM report
        UNION ALL SELECT 3, 'Root cause: Revenue ' || CASE WHEN totals.delta < 0 THEN 'dropped' ELSE 'increased' END || ' by ' || printf('%.1f', abs(totals.pct_change))
               || '% (daily average from ' || format('{{:,.2f}}', totals.p1_daily) || ' to ' || format('{{:,.2f}}', totals.p2_daily) || ').' FROM totals
        UNION ALL SELECT 4, 'Driver: ' || CASE WHEN totals.delta < 0 THEN 'Main decline: ''' ELSE 'Main growth: ''' END || item || ''' in ' || upper(dimension[1]) || dimension[2:]
               || ' changed by ' || CASE WHEN top.pct_change >= 0 THEN '+' ELSE '' END || printf('%.1f', top.pct_change) || '%.' FROM totals, top""",
)
def report_findings(spark, sf_dir):
    parts = report.executive_report(
        sales_planted(spark, sf_dir), "sales", ["order_date", "order_id"], target="revenue", ts="order_date", start=START, end=END, with_models=False
    )
    return parts["findings"]
