"""Quality score, outliers, invalid values and the list of remedies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.numeric import as_double, half_even, ratio
from dataprobe.operators.aggregates import duplicate_count
from dataprobe.operators.profile import profile
from dataprobe.operators.quantiles import quantile_row
from dataprobe.scratch import materialise

# fixed values
NON_NEGATIVE = ("price", "age", "quantity", "cost", "wait_time")
FENCE = 3.0


def fences(quartiles: Column) -> tuple[Column, Column, Column]:
    """IQR and the lower and upper fence from an array (q1, q3)."""
    q1, q3 = quartiles[0], quartiles[1]
    iqr = q3 - q1
    return iqr, q1 - FENCE * iqr, q3 + FENCE * iqr


def outlier_counts(df: DataFrame, columns: list[str], min_rows: int = 10, **kw) -> DataFrame:
    """``column, q1, q3, known, outliers``: values strictly beyond three IQRs, 0 when IQR is 0 or rows are few."""
    q = quantile_row(df, columns, [0.25, 0.75], **kw).unpivot([], columns, "column", "q")
    values = df.select(*[as_double(c).alias(c) for c in columns]).unpivot([], columns, "column", "v")
    iqr, lo, hi = fences(F.col("q"))
    outside = (iqr > 0) & ((F.col("v") < lo) | (F.col("v") > hi))
    # one row per column
    g = values.join(F.broadcast(q), "column").groupBy("column", "q").agg(F.count("v").alias("known"), F.count_if(outside).alias("n"))
    return g.select(
        "column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), "known",
        F.when(F.col("known") >= min_rows, F.col("n")).otherwise(0).alias("outliers"),
    )


def invalid_negatives(df: DataFrame, columns: list[str], words=NON_NEGATIVE) -> DataFrame:
    """``column, negatives`` of the columns whose name says they cannot be negative."""
    cols = [c for c in columns if any(w in c.lower() for w in words)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, negatives long")
    row = df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in cols])
    return row.unpivot([], cols, "column", "negatives")


def constant_columns(profiles: DataFrame) -> DataFrame:
    return profiles.filter((F.col("distinct_count") <= 1) & (F.col("rows") > 1)).select("column_name", "distinct_count")


def score_expr() -> Column:
    """100 minus capped penalties, held to 10..100; over the one-row measurements."""
    rows = F.greatest(F.lit(1), F.col("total_rows"))
    cells = F.greatest(F.lit(1), F.col("total_rows") * F.col("total_columns"))
    cap = lambda limit, c: F.least(F.lit(limit), c)
    penalty = (
        cap(25.0, ratio(F.col("missing_cells"), cells) * 100 * 2.5)
        + cap(20.0, ratio(F.col("duplicate_rows"), rows) * 100 * 3.0)
        + cap(15.0, F.size("constant_columns") * 5.0)
        + cap(15.0, ratio(F.col("outliers"), rows) * 100 * 1.5)
        + cap(10.0, F.size("invalid_values") * 5.0)
    )
    return F.greatest(F.lit(10), F.least(F.lit(100), half_even(100.0 - penalty, 0).cast("int")))


def quality_report(df: DataFrame, profiles: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """One row: score, counts, constant columns, invalid values.

    Reads ``df`` several times; give it a written table when it is expensive to compute. ``exact`` goes to the profile.
    """
    profiles = profiles if profiles is not None else materialise(profile(df, exact), "profile")
    numeric = [r["column_name"] for r in profiles.filter("is_numeric").select("column_name").collect()]
    names = F.array_sort(F.collect_list("column_name"))
    base = profiles.agg(
        F.max("rows").alias("total_rows"), F.count(F.lit(1)).alias("total_columns"), F.sum("missing_count").alias("missing_cells")
    )
    const = constant_columns(profiles).agg(names.alias("constant_columns"))
    dup = duplicate_count(df).select("duplicate_rows")
    rows = profiles.agg(F.max("rows")).first()[0] or 0
    if numeric:
        out = outlier_counts(df, numeric, rows=rows).agg(F.coalesce(F.sum("outliers"), F.lit(0)).alias("outliers"))
    else:
        out = base.select(F.lit(0).cast("long").alias("outliers"))
    bad = invalid_negatives(df, numeric).filter("negatives > 0").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "negatives")))).alias("invalid_values")
    )
    row = base
    for part in (dup, const, out, bad):
        row = row.crossJoin(F.broadcast(part))
    cells = F.greatest(F.lit(1), F.col("total_rows") * F.col("total_columns"))
    return row.withColumn("missing_percent", half_even(ratio(F.col("missing_cells"), cells) * 100, 2)).withColumn(
        "quality_score", score_expr()
    )


def quality_actions(df: DataFrame, profiles: DataFrame, report: DataFrame) -> DataFrame:
    """``action_id, title, description, impact, auto_apply``."""
    def rows(src, when, action, title, text, impact, auto):
        return src.filter(when).select(
            action.alias("action_id"), title.alias("title"), text.alias("description"),
            F.lit(impact).alias("impact"), F.lit(auto).alias("auto_apply"),
        )

    name, missing = F.col("column_name"), F.col("missing_count")
    share = F.format_string("%.1f", half_even(ratio(missing, F.col("rows")) * 100, 1))
    dedupe = rows(
        report, F.col("duplicate_rows") > 0, F.lit("remove_duplicates"), F.lit("Remove Duplicate Records"),
        F.format_string("%d rows repeat an earlier row.", "duplicate_rows"), "High", True,
    )
    dates = rows(
        profiles, F.col("is_date") & (F.col("family") == "string"), F.concat(F.lit("parse_date_"), name),
        F.format_string("Convert '%s' to DateTime", name), F.format_string("'%s' holds dates as text.", name), "High", True,
    )
    impute = rows(
        profiles, missing > 0, F.concat(F.lit("impute_"), name), F.format_string("Handle Missing Values in '%s'", name),
        F.format_string("%d values (%s%%) are missing.", missing, share), "Medium", True,
    )
    flag = rows(
        report, F.col("outliers") > 0, F.lit("flag_outliers"), F.lit("Flag Statistical Outliers"),
        F.format_string("%d values lie outside 3x IQR.", "outliers"), "Low", False,
    )
    return dedupe.unionByName(dates).unionByName(impute).unionByName(flag)
