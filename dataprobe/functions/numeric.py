"""Numeric expressions: coercion, guarded statistics, percentage change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Null, or NaN for the floating types."""
    c = col(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def as_double(c: Column | str) -> Column:
    """Double value or null; unparsable text and NaN become null."""
    d = col(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def to_number(c: Column | str, default: float | None = 0.0) -> Column:
    """Numeric coercion, invalid values replaced by ``default`` (or left null)."""
    d = as_double(c)
    return d if default is None else F.coalesce(d, F.lit(float(default)))


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def pct_change(prev: Column, cur: Column, floor: float = 1.0, digits: int = 1) -> Column:
    """Signed percent change; the denominator is never smaller than ``floor``."""
    prev, cur = prev.cast("double"), cur.cast("double")
    return half_even((cur - prev) / F.greatest(F.abs(prev), F.lit(float(floor))) * 100, digits)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Pairwise-complete correlation, null when either side is constant.

    The built-in ``corr`` divides by zero on a constant column under ANSI mode.
    """
    return pearson_of(as_double(a), as_double(b))


def pearson_of(a: Column, b: Column) -> Column:
    """Same, for double columns without NaN."""
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)


def sample_skewness(c: Column | str) -> Column:
    """Bias-corrected skewness; null below three values or on a constant column."""
    v = as_double(c)
    n = F.count(v).cast("double")
    return F.when(n >= 3, F.try_divide(F.skewness(v) * F.sqrt(n * (n - 1)), n - 2))


def sample_std(c: Column | str) -> Column:
    """Sample standard deviation, 0 for a single row."""
    v = as_double(c)
    return F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0)))


def epoch_micros(ts: Column | str) -> Column:
    """Wall-clock microseconds since 1970 for date, timestamp and timestamp_ntz columns.

    Built from the day and the time of day, so daylight saving of the session's zone plays no part.
    """
    t = col(ts).cast("timestamp_ntz")
    days = F.date_diff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    minutes = F.hour(t) * 60 + F.minute(t)
    micros = (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")
    return days * 86_400_000_000 + minutes.cast("long") * 60_000_000 + micros


def whole_days_between(later: Column, earlier: Column) -> Column:
    """Floor of the elapsed time in days."""
    return F.floor((epoch_micros(later) - epoch_micros(earlier)) / F.lit(86_400_000_000.0)).cast("long")
