"""Daily anomalies and Holt forecasts, per series key or for the whole table.

Raw rows are reduced to one row per key and calendar day first. What follows works on that reduced series,
whose length is bounded by the calendar, so holding one series in an array is safe at any table size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.formatting import title_case
from dataprobe.functions.ladders import severity
from dataprobe.functions.numeric import half_even
from dataprobe.operators import series
from dataprobe.operators.ordering import last_n

ALPHA, BETA = 0.35, 0.15
SHORT_SERIES = 14
HISTORY = 45


# ------------------------------------------------------------------ anomalies

def anomaly_band(daily: DataFrame, *, include_current: bool = False, width: float = 2.5, days: int = 7, keys=()) -> DataFrame:
    """Add expected value, bounds and ``is_outside``.

    With the current day inside its own 7-day frame no day can deviate by 2.5 sample deviations (the most
    is (n-1)/sqrt(n) = 2.27), so the frame is the seven days before unless asked otherwise.
    """
    frame = series.trailing("date", days, include_current, keys)
    mean, std = series.rolling_mean(F.col("sum_val"), frame), series.rolling_std(F.col("sum_val"), frame)
    out = daily.withColumn("expected", mean).withColumn("_s", std)
    enough = F.lit(True) if include_current else F.count("sum_val").over(frame) >= 2
    out = out.withColumn("_ok", enough)
    low = F.greatest(F.lit(0.0), F.col("expected") - width * F.col("_s"))
    out = out.withColumn("lower_bound", low).withColumn("upper_bound", F.col("expected") + width * F.col("_s"))
    v = F.col("sum_val")
    outside = F.col("_ok") & ((v > F.col("upper_bound")) | (v < F.col("lower_bound")))
    return out.withColumn("is_outside", F.coalesce(outside, F.lit(False))).drop("_s", "_ok")


def anomaly_records(banded: DataFrame, metric: str, keys=()) -> DataFrame:
    """Flagged days with severity, direction and a sentence.

    Takes the band's columns and, where the forest has run, ``is_isolated`` and ``score``.
    """
    has_forest = "is_isolated" in banded.columns
    score = F.col("score") if has_forest else F.lit(None).cast("double")
    flagged = banded.filter(F.col("is_outside") | F.coalesce("is_isolated", F.lit(False)) if has_forest else F.col("is_outside"))
    diff = F.col("sum_val") - F.col("expected")
    pct = half_even(diff / F.greatest(F.abs("expected"), F.lit(1.0)) * 100, 1)
    r = flagged.withColumn("change_percent", pct).withColumn("_score", score)
    drop = diff < 0
    title = title_case(F.lit(metric))
    text = F.concat(
        title, F.lit(" had an unusual "),
        F.when(drop, F.format_string("drop of %.1f%%", F.abs("change_percent"))).otherwise(F.format_string("surge of +%.1f%%", "change_percent")),
        F.lit(" compared to the expected range."),
    )
    two = lambda c: half_even(F.col(c), 2)
    return r.select(
        *keys, "date", F.lit(metric).alias("metric"), two("sum_val").alias("actual_value"), two("expected").alias("expected_value"),
        two("lower_bound").alias("lower_bound"), two("upper_bound").alias("upper_bound"), half_even(F.col("_score"), 3).alias("anomaly_score"),
        severity(F.col("change_percent"), F.col("_score")).alias("severity"), "change_percent",
        F.when(drop, "Drop").otherwise("Spike").alias("direction"), text.alias("explanation"),
    )


# ------------------------------------------------------------------- forecast

def densify(daily: DataFrame, value: str = "value", keys=(), least: int = SHORT_SERIES) -> DataFrame:
    """Series under 14 points get every day of an extended calendar, linearly interpolated; others stay."""
    group = daily.groupBy(*keys) if keys else daily.groupBy()
    span = group.agg(F.min("date").alias("_a"), F.max("date").alias("_b"), F.count(F.lit(1)).alias("_n"), F.collect_list("date").alias("_d"))
    missing = (F.lit(least) - F.col("_n")).cast("int")
    days = F.when(F.col("_n") < least, F.sequence("_a", F.date_add("_b", missing), F.expr("interval 1 day"))).otherwise(F.col("_d"))
    grid = span.select(*keys, F.explode(days).alias("date"))
    return series.interpolate(grid.join(daily.select(*keys, "date", value), [*keys, "date"], "left"), value, keys=keys)


def holt(values: Column) -> Column:
    """Final ``level`` and ``trend`` of double exponential smoothing over an array of values.

    The start is the first value and the mean of the first four differences; the fold includes the first
    value.
    """
    n = F.least(F.size(values), F.lit(5))
    first = F.try_element_at(values, F.lit(1))
    trend = F.coalesce(F.try_divide(F.try_element_at(values, n) - first, (n - 1).cast("double")), F.lit(0.0))
    start = F.struct(first.cast("double").alias("level"), trend.cast("double").alias("trend"))

    def step(acc, v):
        level = ALPHA * v + (1 - ALPHA) * (acc["level"] + acc["trend"])
        return F.struct(level.alias("level"), (BETA * (level - acc["level"]) + (1 - BETA) * acc["trend"]).alias("trend"))

    return F.aggregate(values, start, step)


def _series_arrays(daily: DataFrame, value: str, keys) -> DataFrame:
    diff = series.first_difference(F.col(value), "date", keys)
    rows = daily.withColumn("_diff", diff)
    group = rows.groupBy(*keys) if keys else rows.groupBy()
    ordered = F.array_sort(F.collect_list(F.struct("date", F.col(value).cast("double").alias("v"))))
    return group.agg(
        F.transform(ordered, lambda s: s["v"]).alias("values"), F.max("date").alias("last_date"),
        F.stddev_pop("_diff").alias("diff_std"), F.count("_diff").alias("diffs"), F.avg(value).alias("mean"),
    )


def holt_state(daily: DataFrame, value: str = "value", keys=()) -> DataFrame:
    """``level, trend, points`` per series."""
    a = _series_arrays(daily, value, keys).withColumn("s", holt(F.col("values")))
    return a.select(*keys, F.col("s.level").alias("level"), F.col("s.trend").alias("trend"), F.size("values").alias("points"))


def forecast(daily: DataFrame, horizon: int = 30, value: str = "value", keys=()) -> DataFrame:
    """``date, h, predicted, lower_bound, upper_bound`` for the next ``horizon`` days; 95 % band, floored at 0."""
    a = _series_arrays(daily, value, keys).withColumn("s", holt(F.col("values")))
    usable = (F.col("diffs") > 1) & (F.col("diff_std") > 0)
    spread = F.when(usable, F.col("diff_std")).otherwise(F.greatest(F.lit(1.0), F.col("mean") * 0.08))
    h = F.col("h")
    steps = a.withColumn("_spread", spread).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    pred = F.greatest(F.lit(0.0), F.col("s.level") + h * F.col("s.trend"))
    margin = 1.96 * F.col("_spread") * F.sqrt(h.cast("double"))
    r = lambda c: half_even(c, 2)
    return steps.select(
        *keys, F.date_add("last_date", h).alias("date"), "h", r(pred).alias("predicted"),
        r(F.greatest(F.lit(0.0), pred - margin)).alias("lower_bound"), r(pred + margin).alias("upper_bound"),
    )


def backtest(daily: DataFrame, value: str = "value", keys=()) -> DataFrame:
    """Errors on the last part (20 %, at most ten points): ``mae, rmse, mape, accuracy, tested``."""
    a = _series_arrays(daily, value, keys)
    n = F.size("values")
    cut = F.greatest(F.floor(n * F.lit(0.8)).cast("int"), n - 10)
    a = a.withColumn("_cut", cut).withColumn("_test", F.slice("values", F.col("_cut") + 1, F.greatest(F.lit(1), n)))
    a = a.withColumn("s", holt(F.slice("values", F.lit(1), F.col("_cut"))))
    predicted = lambda i: F.greatest(F.lit(0.0), F.col("s.level") + (i + 1) * F.col("s.trend"))
    pairs = F.transform("_test", lambda y, i: F.struct(y.alias("y"), (y - predicted(i)).alias("e")))
    a = a.withColumn("_p", pairs)
    mean = lambda f: F.aggregate("_p", F.lit(0.0), lambda acc, p: acc + f(p)) / F.size("_p")
    mape = F.least(F.lit(99.9), half_even(mean(lambda p: F.abs(p["e"]) / F.greatest(F.abs(p["y"]), F.lit(1.0))) * 100, 1))
    return a.select(
        *keys, half_even(mean(lambda p: F.abs(p["e"])), 2).alias("mae"), half_even(F.sqrt(mean(lambda p: p["e"] * p["e"])), 2).alias("rmse"),
        mape.alias("mape"), F.greatest(F.lit(1.0), half_even(100 - mape, 1)).alias("accuracy"), F.size("_p").alias("tested"),
    )


def forecast_summary(points: DataFrame, metric: str, keys=()) -> DataFrame:
    """Projected change from the first to the last forecast day, as numbers and as a sentence."""
    group = points.groupBy(*keys) if keys else points.groupBy()
    e = group.agg(
        F.min_by("predicted", "h").alias("first_predicted"), F.max_by("predicted", "h").alias("last_predicted"), F.max("h").alias("horizon")
    )
    a, b = F.col("first_predicted"), F.col("last_predicted")
    e = e.withColumn("change_percent", half_even((b - a) / F.greatest(F.abs(a), F.lit(1.0)) * 100, 1))
    word = F.when(F.col("change_percent") >= 0, "expand").otherwise("decline")
    text = F.concat(
        F.format_string("Over the next %d days, ", "horizon"), title_case(F.lit(metric)), F.lit(" is projected to "), word,
        F.format_string(" by %.1f%% (from ", F.abs("change_percent")), F.format_number(a, 2), F.lit(" to "), F.format_number(b, 2), F.lit(")."),
    )
    return e.select(*keys, "first_predicted", "last_predicted", "change_percent", text.alias("summary"))


def history(daily: DataFrame, n: int = HISTORY) -> DataFrame:
    return last_n(daily, n, "date")
