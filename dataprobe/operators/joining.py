"""Joins the analytics need: period alignment, dense calendars, one-row statistics, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align_periods(df: DataFrame, dim: str, period: Column, value: Column) -> DataFrame:
    """Sum of ``value`` per dimension value in each period, 0 where a value is absent in one of them.

    A full outer join of two grouped results; one grouping with conditional sums gives the same rows and
    reads the table once.
    """
    tagged = df.select(F.col(dim), period.alias("_period"), value.alias("_v")).filter(F.col("_period").isNotNull())
    part = lambda p: F.coalesce(F.sum(F.when(F.col("_period") == p, F.col("_v"))), F.lit(0))
    return tagged.filter(F.col(dim).isNotNull()).groupBy(dim).agg(part("p1").alias("p1"), part("p2").alias("p2"))


def full_outer_zero(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Full outer equi join, missing numbers as 0."""
    return left.join(right, on, "full_outer").na.fill(0)


def dense_calendar(daily: DataFrame, date: str = "date", extra_days: int | Column = 0) -> DataFrame:
    """Every day from the first to the last of ``daily`` (plus ``extra_days``), left-joined to it."""
    extra = F.lit(extra_days) if isinstance(extra_days, int) else extra_days
    span = daily.agg(F.min(date).alias("_a"), F.max(date).alias("_b"), F.count(F.lit(1)).alias("_n"))
    last = F.date_add("_b", extra.cast("int"))
    days = span.select(F.explode(F.sequence("_a", last, F.expr("interval 1 day"))).alias(date))
    return days.join(daily, date, "left")


def with_stats(df: DataFrame, *stats: Column) -> DataFrame:
    """Attach table-wide statistics to every row; the statistics are a single row."""
    return df.crossJoin(F.broadcast(df.agg(*stats)))


def keep_members(df: DataFrame, column: str, members) -> DataFrame:
    """Rows whose value is in a list, or in the one column of another DataFrame."""
    if isinstance(members, DataFrame):
        key = members.columns[0]
        return df.join(members.select(F.col(key).alias(column)).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(list(members)))
