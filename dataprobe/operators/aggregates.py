"""Grouped and table-wide aggregates. All columns of a table are aggregated in one pass, then unpivoted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.numeric import half_even, is_missing
from dataprobe.operators.joining import with_stats

AGGREGATIONS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "avg": F.avg,
    "max": F.max,
    "min": F.min,
}


def aggregate_expr(agg: str, metric: str | None) -> Column:
    if agg == "count" or metric is None:
        return F.count(F.lit(1))
    return AGGREGATIONS[agg](F.col(metric))


def breakdown(df: DataFrame, dim: str | None, metric: str | None, agg: str = "sum", digits: int | None = 2) -> DataFrame:
    """``label, value, count`` per value of ``dim`` (nulls dropped), or one row without a dimension."""
    value = aggregate_expr(agg, metric).cast("double")
    if digits is not None:
        value = half_even(value, digits)
    cols = [value.alias("value"), F.count(F.lit(1)).alias("count")]
    if dim is None:
        return df.agg(*cols)
    return df.filter(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("label")).agg(*cols)


def daily_rollup(df: DataFrame, ts: str, metric: str, keys: list[str] | None = None) -> DataFrame:
    """Sum, mean and count per calendar day, optionally per series key; rows without a day or value are dropped."""
    rows = df.select(*(keys or []), F.to_date(ts).alias("date"), F.col(metric).alias("_v"))
    rows = rows.filter(F.col("date").isNotNull() & F.col("_v").isNotNull())
    return rows.groupBy(*(keys or []), "date").agg(
        F.sum("_v").cast("double").alias("sum_val"),
        F.avg("_v").cast("double").alias("mean_val"),
        F.count("_v").alias("count"),
    )


def _unpivot(row: DataFrame, columns: list[str], value: str) -> DataFrame:
    return row.select(*[F.col(f"{i}").alias(c) for i, c in enumerate(columns)]).unpivot([], columns, "column", value)


def distinct_counts(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct non-null values per column."""
    columns = columns or df.columns
    types = dict((f.name, f.dataType) for f in df.schema)
    count = F.count_distinct if exact else F.approx_count_distinct
    known = lambda c: F.when(~is_missing(c, types[c]), F.col(c))
    row = df.agg(*[count(known(c)).alias(f"{i}") for i, c in enumerate(columns)])
    return _unpivot(row, columns, "distinct_count")


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing cells per column with the row count and percentage."""
    cols = df.columns
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(is_missing(f.name, f.dataType)).alias(f"{i}") for i, f in enumerate(df.schema)],
    )
    long = row.select("_rows", *[F.col(f"{i}").alias(c) for i, c in enumerate(cols)]).unpivot(
        ["_rows"], cols, "column", "missing_count"
    )
    pct = half_even(F.try_divide(F.col("missing_count").cast("double"), F.col("_rows").cast("double")) * 100, 2)
    return long.select("column", "missing_count", F.col("_rows").alias("rows"), pct.alias("missing_percent"))


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent text value per column, the smallest on ties: ``column, mode, count``.

    Grouped by value first, so no task ever holds a whole column's values.
    """
    counts = value_counts_by_column(df, columns)
    best = F.min(F.struct((-F.col("count")).alias("neg"), F.col("value").alias("value"))).alias("best")
    return counts.groupBy("column").agg(best).select(
        "column", F.col("best.value").alias("mode"), (-F.col("best.neg")).alias("count")
    )


def value_counts_by_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, count`` over several columns as text, nulls excluded.

    Rows are dealt to tasks of the planner's size first: a task groups all columns' values of its rows in memory, and a split of
    a file that packs well holds many rows.
    """
    dealt = df.select(*columns).hint("rebalance")
    text = dealt.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot([], columns, "column", "value").filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def value_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), "value").limit(k)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one, with the row count: ``rows, duplicate_rows``."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def share_of_total(grouped: DataFrame, value: str, out: str = "share", digits: int = 1) -> DataFrame:
    """Percentage of the column's total; the total is one row, so any number of groups works."""
    both = with_stats(grouped, F.sum(value).alias("_total"))
    share = F.try_divide(F.col(value).cast("double"), F.col("_total").cast("double")) * 100
    return both.withColumn(out, half_even(share, digits)).drop("_total")
