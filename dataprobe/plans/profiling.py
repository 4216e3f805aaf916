"""Profiles, quality, cleaning, exploratory analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataprobe.operators import clean, eda, quality
from dataprobe.operators.profile import profile, target_ranking
from dataprobe.plans.inputs import EVENTS_DIRTY, SALES, events_dirty, sales
from dataprobe.plans.registry import query, table
from dataprobe.scratch import materialise

COLUMNS = ["event_id", "ts", "user_id", "event_type", "channel", "value", "source", "is_error"]
TYPES = {
    "event_id": "integer", "ts": "datetime", "user_id": "integer", "event_type": "string", "channel": "string",
    "value": "float", "source": "string", "is_error": "integer",
}


def _cents(expr):
    return f"regexp_replace(CAST(CAST(round(CAST({expr} AS DOUBLE), 2) AS DECIMAL(38,2)) AS VARCHAR), '0$', '')"


def facts_sql(src: str, types: dict[str, str]) -> str:
    """``facts``: one row per column of ``src`` measured by plain SQL."""
    parts = []
    for i, (c, fam) in enumerate(types.items()):
        num = fam in ("integer", "float")
        nb = f"count(*) FILTER ({c} NOT IN (0, 1))" if num else (
            f"count(*) FILTER ({c} NOT IN ('0','1','true','false','True','False'))" if fam == "string" else "0")
        fr = f"count(*) FILTER ({c} % 1 <> 0)" if num else "0"
        dt = f"count(*) FILTER (try_cast({c} AS TIMESTAMP) IS NOT NULL)" if fam == "string" else "0"
        if num:
            lo, hi = _cents(f"min({c})"), _cents(f"max({c})")
        elif fam == "datetime":
            lo, hi = f"strftime(min({c}), '%Y-%m-%d %H:%M:%S')", f"strftime(max({c}), '%Y-%m-%d %H:%M:%S')"
        else:
            lo, hi = f"min({c})", f"max({c})"
        sample = (
            f"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {src}"
            f" WHERE {c} IS NOT NULL ORDER BY v LIMIT 5))"
        )
        parts.append(
            f"SELECT {i} AS position, '{c}' AS column_name, '{fam}' AS family, count(*) AS rows, count(*) - count({c}) AS missing_count,"
            f" count(DISTINCT {c}) AS distinct_count, {nb} AS not_boolean, {fr} AS fractions, {dt} AS dates, {lo} AS lo, {hi} AS hi,"
            f" {sample} AS sample_values FROM {src}"
        )
    typed = """typed AS (SELECT *, CASE
        WHEN rows = missing_count THEN 'text' WHEN family = 'datetime' THEN 'datetime'
        WHEN family IN ('integer', 'string') AND not_boolean = 0 AND distinct_count <= 2 THEN 'boolean'
        WHEN family = 'integer' OR (family = 'float' AND fractions = 0) THEN 'integer'
        WHEN family = 'float' THEN 'float'
        WHEN dates >= (rows - missing_count) * 0.8 THEN 'datetime'
        WHEN regexp_matches(lower(column_name), 'id|code|uuid') THEN 'id'
        WHEN distinct_count <= 60 OR distinct_count / greatest(rows, 1) < 0.10 THEN 'categorical'
        ELSE 'text' END AS detected_type FROM facts)"""
    return f"facts AS ({' UNION ALL '.join(parts)}), {typed}"


DIRTY_FACTS = EVENTS_DIRTY + ", " + facts_sql("dirty", TYPES)


@query("infer_types", f"WITH {DIRTY_FACTS} SELECT column_name, detected_type FROM typed")
def infer_types(spark, sf_dir):
    return profile(events_dirty(spark, sf_dir)).select("column_name", "detected_type")


@query(
    "profile_table",
    f"""WITH {DIRTY_FACTS}
        SELECT column_name, detected_type, detected_type = 'datetime' AS is_date,
               detected_type IN ('integer', 'float') AS is_numeric, detected_type = 'categorical' AS is_categorical,
               (detected_type IN ('integer', 'float') AND regexp_matches(column_name, 'revenue|profit|sales|churn|target|score|amount|cost'))
               OR (detected_type = 'boolean' AND regexp_matches(column_name, 'churn|cancelled|fraud|converted')) AS is_target_candidate,
               distinct_count, missing_count,
               CASE WHEN detected_type IN ('integer', 'float', 'datetime') THEN lo END AS min_value,
               CASE WHEN detected_type IN ('integer', 'float', 'datetime') THEN hi END AS max_value
        FROM typed""",
)
def profile_table(spark, sf_dir):
    return profile(events_dirty(spark, sf_dir)).select(
        "column_name", "detected_type", "is_date", "is_numeric", "is_categorical", "is_target_candidate",
        "distinct_count", "missing_count", "min_value", "max_value",
    )


_PART_TYPES = {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "float"}


@query(
    "profile_samples",
    f"WITH {facts_sql('part', _PART_TYPES)} SELECT column_name, detected_type, sample_values, distinct_count FROM typed",
)
def profile_samples(spark, sf_dir):
    return profile(table(spark, sf_dir, "part")).select(
        "column_name", "detected_type", F.array_join("sample_values", "|").alias("sample_values"), "distinct_count"
    )


NUMERIC = ["event_id", "user_id", "value"]


def outliers_sql(src: str, columns: list[str], least: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", any_value(q1) AS q1, any_value(q3) AS q3, count({c}) AS known,
            CASE WHEN count({c}) >= {least} THEN count(*) FILTER (q3 - q1 > 0 AND ({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)))
            ELSE 0 END AS outliers
            FROM {src}, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {src})"""
        for c in columns
    )


@query(
    "outliers_3iqr",
    f"""WITH {EVENTS_DIRTY}, o AS ({outliers_sql("dirty", NUMERIC, 10)})
        SELECT "column", round(q1, 4) AS q1, round(q3, 4) AS q3, known, outliers FROM o""",
)
def outliers_3iqr(spark, sf_dir):
    o = quality.outlier_counts(events_dirty(spark, sf_dir), NUMERIC)
    return o.withColumns({"q1": F.round("q1", 4), "q3": F.round("q3", 4)})


def _ledger(spark, sf_dir):
    """Accounts with columns that must not be negative."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_acctbal").alias("unit_price"), (F.col("c_acctbal") - 500).alias("cost"), F.col("c_nationkey").alias("age")
    )


@query(
    "invalid_negatives",
    """SELECT 'unit_price' AS "column", count(*) FILTER (c_acctbal < 0) AS negatives FROM customer
       UNION ALL SELECT 'cost', count(*) FILTER (c_acctbal - 500 < 0) FROM customer
       UNION ALL SELECT 'age', count(*) FILTER (c_nationkey < 0) FROM customer""",
)
def invalid_negatives(spark, sf_dir):
    return quality.invalid_negatives(_ledger(spark, sf_dir), ["unit_price", "cost", "age"])


@query(
    "constant_columns",
    f"WITH {DIRTY_FACTS} SELECT column_name, distinct_count FROM typed WHERE distinct_count <= 1 AND rows > 1",
)
def constant_columns(spark, sf_dir):
    return quality.constant_columns(profile(events_dirty(spark, sf_dir)))


def report_sql(src: str, types: dict[str, str], numeric: list[str], invalid: str = "0") -> str:
    """``report``: the measurements and the score of ``src``; needs ``typed``."""
    return f"""outl AS ({outliers_sql(src, numeric, 10)}),
      m AS (SELECT max(rows) AS total_rows, count(*) AS total_columns, CAST(sum(missing_count) AS BIGINT) AS missing_cells,
                   count(*) FILTER (distinct_count <= 1 AND rows > 1) AS constants,
                   string_agg(column_name, '|' ORDER BY column_name) FILTER (distinct_count <= 1 AND rows > 1) AS constant_columns FROM typed),
      d AS (SELECT (SELECT count(*) FROM {src}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS duplicate_rows),
      o AS (SELECT CAST(sum(outliers) AS BIGINT) AS outliers FROM outl),
      report AS (SELECT *, round_even(missing_cells / (total_rows * total_columns) * 100, 2) AS missing_percent,
        greatest(10, least(100, CAST(round_even(100.0::DOUBLE - (
            least(25.0, missing_cells / (total_rows * total_columns) * 100 * 2.5) + least(20.0, duplicate_rows / total_rows * 100 * 3.0)
            + least(15.0, constants * 5.0) + least(15.0, outliers / total_rows * 100 * 1.5) + least(10.0, {invalid} * 5.0)), 0) AS INTEGER))) AS quality_score
        FROM m, d, o)"""


DIRTY_REPORT = DIRTY_FACTS + ", " + report_sql("dirty", TYPES, NUMERIC)


@query("quality_score", f"WITH {DIRTY_REPORT} SELECT quality_score FROM report")
def quality_score(spark, sf_dir):
    return quality.quality_report(materialise(events_dirty(spark, sf_dir), "dirty")).select("quality_score")


_REPORT_COLUMNS = ["quality_score", "total_rows", "total_columns", "missing_cells", "missing_percent", "duplicate_rows", "outliers"]


@query(
    "quality_report",
    f"WITH {DIRTY_REPORT} SELECT {', '.join(_REPORT_COLUMNS)}, constant_columns, CAST(0 AS INTEGER) AS invalid_columns FROM report",
)
def quality_report(spark, sf_dir):
    return quality.quality_report(materialise(events_dirty(spark, sf_dir), "dirty")).select(
        *_REPORT_COLUMNS, F.array_join("constant_columns", "|").alias("constant_columns"), F.size("invalid_values").alias("invalid_columns")
    )


@query(
    "quality_actions",
    f"""WITH {DIRTY_REPORT}
        SELECT 'remove_duplicates' AS action_id, 'Remove Duplicate Records' AS title,
               duplicate_rows || ' rows repeat an earlier row.' AS description, 'High' AS impact, true AS auto_apply FROM report WHERE duplicate_rows > 0
        UNION ALL SELECT 'parse_date_' || column_name, 'Convert ''' || column_name || ''' to DateTime',
               '''' || column_name || ''' holds dates as text.', 'High', true FROM typed WHERE detected_type = 'datetime' AND family = 'string'
        UNION ALL SELECT 'impute_' || column_name, 'Handle Missing Values in ''' || column_name || '''',
               missing_count || ' values (' || printf('%.1f', round_even(missing_count / rows * 100, 1)) || '%) are missing.', 'Medium', true
               FROM typed WHERE missing_count > 0
        UNION ALL SELECT 'flag_outliers', 'Flag Statistical Outliers', outliers || ' values lie outside 3x IQR.', 'Low', false FROM report WHERE outliers > 0""",
)
def quality_actions(spark, sf_dir):
    d = materialise(events_dirty(spark, sf_dir), "dirty")
    p = materialise(profile(d), "profile")
    return quality.quality_actions(d, p, quality.quality_report(d, p))


@query(
    "target_ranking",
    f"""WITH {SALES}, n AS (SELECT unnest(['order_id', 'customer_id', 'quantity', 'discount', 'revenue', 'order_status', 'total_price']) AS c,
                                   unnest([0, 1, 2, 3, 4, 5, 6]) AS position, (SELECT count(*) FROM sales) AS rows)
        SELECT c AS column_name, CAST(CASE c WHEN 'revenue' THEN 1 WHEN 'total_price' THEN 18 WHEN 'order_status' THEN 23 ELSE 200 END AS INTEGER) AS priority,
               CASE WHEN c IN ('revenue', 'total_price', 'order_status') THEN 'keyword' ELSE 'numeric' END AS reason FROM n WHERE rows > 5""",
)
def target_ranking_query(spark, sf_dir):
    s = sales(spark, sf_dir).select(
        "order_id", "customer_id", "quantity", "discount", "revenue", F.col("priority").alias("order_status"),
        F.col("revenue").alias("total_price"),
    )
    return target_ranking(profile(materialise(s, "ranking"))).select("column_name", "priority", "reason")


# ------------------------------------------------------------------- cleaning

FILL_SQL = """fill AS (SELECT CASE WHEN abs(skewness(value)) > 1 THEN quantile_cont(value, 0.5) ELSE avg(value) END AS fv,
    CASE WHEN abs(skewness(user_id)) > 1 THEN quantile_cont(user_id::DOUBLE, 0.5) ELSE avg(user_id) END AS fu FROM {src})"""


@query(
    "impute_numeric",
    f"""WITH {EVENTS_DIRTY}, gaps AS (SELECT event_id, CASE WHEN event_id % 20 <> 0 THEN user_id END AS user_id, value FROM dirty),
        {FILL_SQL.format(src="gaps")}
        SELECT event_id, round(coalesce(user_id, fu), 6) AS user_id, round(coalesce(value, fv), 6) AS value FROM gaps, fill""",
)
def impute_numeric(spark, sf_dir):
    d = events_dirty(spark, sf_dir).select(
        "event_id", F.when(F.col("event_id") % 20 != 0, F.col("user_id")).alias("user_id"), "value"
    )
    i = clean.impute_numeric(d, ["user_id", "value"])
    return i.select("event_id", F.round("user_id", 6).alias("user_id"), F.round("value", 6).alias("value"))


_MODE = """(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""


def cat_fill(c, src):
    return f"""coalesce({c}, CASE WHEN (SELECT count(*) FILTER ({c} IS NULL) / count(*) FROM {src}) < 0.05 THEN {_MODE.format(c=c, src=src)} ELSE 'Unknown' END)"""


@query(
    "impute_categorical",
    f"""WITH {EVENTS_DIRTY} SELECT {cat_fill("event_type", "dirty")} AS event_type, {cat_fill("channel", "dirty")} AS channel,
        count(*) AS n FROM dirty GROUP BY ALL""",
)
def impute_categorical(spark, sf_dir):
    d = events_dirty(spark, sf_dir).select("event_id", "event_type", "channel")
    i = clean.impute_categorical(d, ["event_type", "channel"])
    return i.groupBy("event_type", "channel").agg(F.count(F.lit(1)).alias("n"))


BOTH_WAYS = """coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY event_id),
   first_value({c} IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(
    "impute_dates",
    f"""WITH {EVENTS_DIRTY}, u AS (SELECT DISTINCT * FROM dirty)
        SELECT event_id, strftime({BOTH_WAYS.format(c="ts")}, '%Y-%m-%d %H:%M:%S') AS ts FROM u""",
)
def impute_dates(spark, sf_dir):
    d = events_dirty(spark, sf_dir).dropDuplicates().select("event_id", "ts")
    i = clean.impute_dates(d, ["ts"], ["event_id"])
    return i.select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(
    "flag_outliers",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
       SELECT event_id, value, (q3 - q1 > 0) AND (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)) AS value_outlier
       FROM events, q""",
)
def flag_outliers(spark, sf_dir):
    return clean.flag_outliers(table(spark, sf_dir, "events").select("event_id", "value"), ["value"])


CLEANED = f"""{EVENTS_DIRTY}, uniq AS (SELECT DISTINCT * FROM dirty), {FILL_SQL.format(src="uniq")},
  filled AS (SELECT event_id, {BOTH_WAYS.format(c="ts")} AS ts, user_id, {cat_fill("event_type", "uniq")} AS event_type,
             {cat_fill("channel", "uniq")} AS channel, coalesce(value, fv) AS value, source, is_error FROM uniq, fill)"""
_FLAG = "({c} < (SELECT quantile_cont({c}::DOUBLE, 0.25) - 3 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) FROM filled) OR {c} > (SELECT quantile_cont({c}::DOUBLE, 0.75) + 3 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) FROM filled))"


@query(
    "cleaned_table",
    f"""WITH {CLEANED} SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, channel, round(value, 6) AS value,
        source, is_error, {_FLAG.format(c="value")} AS value_outlier FROM filled""",
)
def cleaned_table(spark, sf_dir):
    out, _ = clean.clean(events_dirty(spark, sf_dir), ["event_id"])
    return out.select(
        "event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("ts"), "user_id", "event_type",
        "channel", F.round("value", 6).alias("value"), "source", "is_error", "value_outlier",
    )


@query(
    "clean_report",
    f"""WITH {CLEANED}, n AS (SELECT (SELECT count(*) FROM dirty) AS original_rows, (SELECT count(*) FROM filled) AS processed_rows)
        SELECT original_rows, processed_rows, original_rows - processed_rows AS duplicates_removed,
               'channel: ''Unknown''|event_type: ''' || {_MODE.format(c="event_type", src="uniq")} || '''|ts: forward/backward fill|value: '
               || (SELECT CASE WHEN abs(skewness(value)) > 1 THEN 'median' ELSE 'mean' END FROM uniq) || ' (' || printf('%.2f', (SELECT fv FROM fill)) || ')' AS imputed,
               (SELECT CAST(sum({_FLAG.format(c="event_id")}::INT + {_FLAG.format(c="user_id")}::INT + {_FLAG.format(c="value")}::INT) AS BIGINT) FROM filled) AS outliers_flagged
        FROM n""",
)
def clean_report(spark, sf_dir):
    _, report = clean.clean(events_dirty(spark, sf_dir), ["event_id"])
    return report.withColumn("imputed", F.array_join("imputed", "|"))


@query(
    "quality_after_clean",
    f"""WITH {CLEANED}, {facts_sql("filled", TYPES)}, {report_sql("filled", TYPES, NUMERIC)}
        SELECT {', '.join(_REPORT_COLUMNS)}, constant_columns FROM report""",
)
def quality_after_clean(spark, sf_dir):
    out, _ = clean.clean(events_dirty(spark, sf_dir), ["event_id"], mark_outliers=False)
    return quality.quality_report(materialise(out, "cleaned")).select(
        *_REPORT_COLUMNS, F.array_join("constant_columns", "|").alias("constant_columns")
    )


# ------------------------------------------------------------------ exploring

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "eda_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round_even(avg({c}), 2) AS mean, round_even(stddev_samp({c}), 2) AS std,
            round_even(min({c}), 2) AS min, round_even(quantile_cont({c}, 0.25), 2) AS q25, round_even(quantile_cont({c}, 0.5), 2) AS median,
            round_even(quantile_cont({c}, 0.75), 2) AS q75, round_even(max({c}), 2) AS max FROM lineitem"""
        for c in LI
    ),
)
def eda_summary(spark, sf_dir):
    return eda.summary(table(spark, sf_dir, "lineitem").select(*LI))


_HIST = ["value", "user_id"]


@query(
    "eda_histogram",
    f"""WITH v AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, CAST({c} AS DOUBLE) AS v FROM events" for c in _HIST)}),
        e AS (SELECT c, min(v) AS a, max(v) AS b FROM v GROUP BY c),
        n AS (SELECT v.c, CAST(least(floor((v - a) / (b - a) * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM v JOIN e ON v.c = e.c GROUP BY ALL),
        g AS (SELECT c, a, b, CAST(unnest(range(10)) AS INTEGER) AS bin FROM e)
        SELECT g.c AS "column", g.bin, round_even(a + (b - a) * g.bin / 10, 1) AS lo, round_even(a + (b - a) * (g.bin + 1) / 10, 1) AS hi,
               coalesce(n, 0) AS count FROM g LEFT JOIN n ON g.c = n.c AND g.bin = n.bin""",
)
def eda_histogram(spark, sf_dir):
    return eda.histogram(table(spark, sf_dir, "events").select(*_HIST))


def _corr_sql(src, cols):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round_even(corr({a}, {b}), 2) AS correlation FROM {src}" for a in cols for b in cols
    )


@query("eda_correlation", _corr_sql("lineitem", LI))
def eda_correlation(spark, sf_dir):
    return eda.correlations(table(spark, sf_dir, "lineitem").select(*LI))


@query(
    "eda_categorical",
    """WITH c AS (SELECT 'p_name' AS "column", p_name AS category, count(*) AS count FROM part GROUP BY 2
                  UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2),
       d AS (SELECT *, count(*) OVER (PARTITION BY "column") AS n, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, category) AS rank FROM c)
       SELECT "column", category, count, CAST(rank AS INTEGER) AS rank FROM d WHERE n <= 30 AND rank <= 8""",
)
def eda_categorical(spark, sf_dir):
    return eda.category_counts(table(spark, sf_dir, "part"))


@query(
    "strong_correlations",
    """WITH t AS (SELECT l_quantity AS quantity, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 + l_tax) AS gross, l_discount AS discount FROM lineitem),
       p AS (SELECT 1 AS k, 'quantity' AS x, 'price' AS y, corr(quantity, price) AS r FROM t UNION ALL SELECT 2, 'quantity', 'net', corr(quantity, net) FROM t
             UNION ALL SELECT 3, 'quantity', 'gross', corr(quantity, gross) FROM t UNION ALL SELECT 4, 'quantity', 'discount', corr(quantity, discount) FROM t
             UNION ALL SELECT 5, 'price', 'net', corr(price, net) FROM t UNION ALL SELECT 6, 'price', 'gross', corr(price, gross) FROM t
             UNION ALL SELECT 7, 'price', 'discount', corr(price, discount) FROM t UNION ALL SELECT 8, 'net', 'gross', corr(net, gross) FROM t
             UNION ALL SELECT 9, 'net', 'discount', corr(net, discount) FROM t UNION ALL SELECT 10, 'gross', 'discount', corr(gross, discount) FROM t)
       SELECT x, y, round_even(r, 2) AS correlation FROM p WHERE abs(r) >= 0.4 ORDER BY k LIMIT 8""",
)
def strong_correlations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    return eda.strong_pairs(
        li.select(
            F.col("l_quantity").alias("quantity"), price.alias("price"), (price * (1 - F.col("l_discount"))).alias("net"),
            (price * (1 + F.col("l_tax"))).alias("gross"), F.col("l_discount").alias("discount"), F.col("l_orderkey").alias("order_id"),
        )
    )
