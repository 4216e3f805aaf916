"""Window functions over finished daily series, and splits of raw rows in time.

A daily series has one row per day and key, so a window per key stays small whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataprobe.functions.numeric import epoch_micros, half_even
from dataprobe.operators.quantiles import quantile_row


def _window(date: str | Column, keys):
    return (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(date)


def trailing(date: str, days: int = 7, include_current: bool = True, keys=()):
    """Frame of the last ``days`` rows, or of the ``days`` rows before the current one."""
    w = _window(date, keys)
    return w.rowsBetween(-(days - 1), 0) if include_current else w.rowsBetween(-days, -1)


def rolling_mean(v: Column, frame) -> Column:
    return F.avg(v).over(frame)


def rolling_std(v: Column, frame) -> Column:
    """Sample deviation of the frame, 0 while it holds one row."""
    return F.coalesce(F.stddev_samp(v).over(frame), F.lit(0.0))


def rolling_with_minimum(v: Column, frame, least: int) -> tuple[Column, Column]:
    """Mean and deviation, null until the frame holds ``least`` values."""
    enough = F.count(v).over(frame) >= least
    return F.when(enough, F.avg(v).over(frame)), F.when(enough, F.stddev_samp(v).over(frame))


def first_difference(v: Column, date: str, keys=()) -> Column:
    return v - F.lag(v).over(_window(date, keys))


def interpolate(df: DataFrame, value: str, date: str = "date", keys=()) -> DataFrame:
    """Linear in time between known points; edges take the nearest known value."""
    past = _window(date, keys).rowsBetween(Window.unboundedPreceding, 0)
    future = _window(F.col(date).desc(), keys).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(date).alias("d"), F.col(value).alias("v")))
    both = df.withColumn("_p", F.last(known, ignorenulls=True).over(past)).withColumn(
        "_n", F.last(known, ignorenulls=True).over(future)
    )
    span = F.date_diff("_n.d", "_p.d")
    between = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * F.try_divide(
        F.date_diff(F.col(date), F.col("_p.d")).cast("double"), span.cast("double")
    )
    filled = F.coalesce(F.col(value), between, F.col("_p.v"), F.col("_n.v"))
    return both.withColumn(value, filled).drop("_p", "_n")


def split_at_quantile(df: DataFrame, ts: str, share: float = 0.5, **kw) -> DataFrame:
    """``p1`` before the quantile of the timestamps, ``p2`` from it on; null timestamps get no period."""
    t = df.withColumn("_t", epoch_micros(ts))
    cut = quantile_row(t.select("_t"), ["_t"], [share], **kw).select(F.col("_t")[0].alias("_cut"))
    return (
        t.crossJoin(F.broadcast(cut))
        .withColumn("period", F.when(F.col("_t") < F.col("_cut"), "p1").when(F.col("_t") >= F.col("_cut"), "p2"))
        .drop("_t", "_cut")
    )


def first_to_last(daily: DataFrame, value: str, date: str = "date", keys=()) -> DataFrame:
    """First and last value of the series with the percent change between them."""
    ends = daily.groupBy(*keys).agg(
        F.min_by(value, date).alias("first_value"), F.max_by(value, date).alias("last_value")
    )
    a, b = F.col("first_value"), F.col("last_value")
    return ends.withColumn("change_percent", half_even((b - a) / F.greatest(F.abs(a), F.lit(1.0)) * 100, 1))


def head_tail_change(daily: DataFrame, value: str, points: int = 15, date: str = "date", keys=()) -> DataFrame:
    """Mean of the first and of the last ``points`` days with the percent change."""
    up = F.row_number().over(_window(date, keys))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    down = F.row_number().over(w.orderBy(F.col(date).desc()))
    ranked = daily.withColumn("_up", up).withColumn("_down", down)
    ends = ranked.groupBy(*keys).agg(
        F.avg(F.when(F.col("_up") <= points, F.col(value))).alias("head_mean"),
        F.avg(F.when(F.col("_down") <= points, F.col(value))).alias("tail_mean"),
    )
    a, b = F.col("head_mean"), F.col("tail_mean")
    return ends.withColumn("change_percent", half_even((b - a) / F.greatest(F.abs(a), F.lit(1.0)) * 100, 1))
