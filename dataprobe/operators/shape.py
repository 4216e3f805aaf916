"""Projections, filters, coercions, period tags and generated columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.functions.numeric import as_double, col
from dataprobe.operators.ordering import row_index
from dataprobe.operators.quantiles import median_row
from dataprobe.operators.selection import first_rows


def safe_name(name: str) -> str:
    """Lower-case word characters with blanks as underscores."""
    kept = re.sub(r"[^\w\s]", "", str(name).strip().lower())
    return re.sub(r"\s+", "_", kept) or "col"


def safe_names(names: list[str]) -> list[str]:
    """Safe names in order, later collisions numbered from 2."""
    out: list[str] = []
    for name in map(safe_name, names):
        candidate, n = name, 1
        while candidate in out:
            n += 1
            candidate = f"{name}_{n}"
        out.append(candidate)
    return out


def sanitise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*safe_names(df.columns))


NUMERIC = (T.NumericType,)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """Names of the ``numeric``, ``string`` or ``date`` columns of the schema."""
    wanted = {"numeric": NUMERIC, "string": (T.StringType,), "date": TEMPORAL}[kind]
    return [f.name for f in df.schema if isinstance(f.dataType, wanted)]


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*columns_of(df, kind))


#: the day part of a text by how it begins; slashes are month first, day first only where that is no date
DATE_SHAPES = (
    (r"^\d{4}", ("y/M/d", "y-M-d")),
    (r"^\d{1,2}/", ("M/d/y", "d/M/y")),
    (r"^\d{1,2}-\d", ("d-M-y",)),
    (r"^\d{1,2}[- ][A-Za-z]", ("d-MMM-y", "d MMM y", "d MMMM y")),
    (r"^[A-Za-z]{3}", ("MMM d, y", "MMMM d, y", "MMM d y")),
)
TIMES = ("", " H:mm", " H:mm:ss", "'T'H:mm:ss", " h:mm a")


def parse_timestamp(c: Column | str) -> Column:
    """Timestamp from common text forms, null where none fits.

    Year first, ``1/31/2024`` (month first; day first if the month would be over 12), ``31-1-2024``, ``31-Jan-2024``,
    ``Jan 31, 2024``, each also with a time of day. A text is tried only with the forms it begins like.
    """
    c = F.trim(col(c).cast("string"))
    out = c.try_cast("timestamp")
    for begin, days in DATE_SHAPES:
        tries = [F.try_to_timestamp(c, F.lit(d + t)) for t in TIMES for d in days]
        out = F.coalesce(out, F.when(c.rlike(begin), F.coalesce(*tries)))
    return out


def coerce_dates(df: DataFrame, column: str, min_share: float = 0.3, out: str | None = None) -> DataFrame:
    """Parse ``column``; keep the parsed column only when more than ``min_share`` of all rows parse."""
    parsed = df.withColumn("_parsed", parse_timestamp(column))
    gate = parsed.agg((F.avg(F.col("_parsed").isNotNull().cast("int")) > min_share).alias("_ok"))
    return (
        parsed.crossJoin(F.broadcast(gate))
        .withColumn(out or column, F.when(F.col("_ok"), F.col("_parsed")))
        .drop("_parsed", "_ok")
    )


def _native_equal(field: T.StructField, value) -> Column:
    """Compare in the column's own type where the text stands for exactly one value, so it can be pushed down."""
    c = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return c == str(value)
    if isinstance(field.dataType, T.IntegralType) and re.fullmatch(r"-?(0|[1-9]\d{0,8})", str(value)):
        return c == int(value)
    return c.cast("string") == str(value)


def filter_equal(df: DataFrame, wanted: dict) -> DataFrame:
    """All ``column = value`` conditions; empty values and unknown columns are ignored."""
    fields = {f.name: f for f in df.schema}
    for name, value in wanted.items():
        if name in fields and value is not None and str(value) != "":
            df = df.filter(_native_equal(fields[name], value))
    return df


def tag_period(ts: Column | str, start, end=None) -> Column:
    """``p1`` before ``start``, ``p2`` from ``start`` to ``end`` inclusive, null elsewhere."""
    t = col(ts)
    start = F.lit(start).cast("timestamp_ntz")
    t = t.cast("timestamp_ntz")
    late = t >= start
    if end is not None:
        late = late & (t <= F.lit(end).cast("timestamp_ntz"))
    return F.when(t < start, "p1").when(late, "p2")


def split_by_position(df: DataFrame, order_by: list, share: float = 0.55) -> DataFrame:
    """Tag the first ``share`` of the ordered rows ``p1`` and the rest ``p2``, by comparison with the key at the cut.

    ``order_by`` names columns and ends in a unique key.
    """
    total = df.count()
    cut = max(1, math.floor(total * share))
    return first_rows(df, order_by, cut, total).withColumn("period", F.when(F.col("_first"), "p1").otherwise("p2")).drop("_first")


def high_low_bins(df: DataFrame, column: str, out: str = "bin") -> DataFrame:
    """``High <Title>`` at or above the median, ``Low <Title>`` below."""
    title = column.replace("_", " ").title()
    mid = median_row(df, [column]).select(F.col(column).alias("_median"))
    return (
        df.crossJoin(F.broadcast(mid))
        .withColumn(out, F.when(as_double(column) >= F.col("_median"), f"High {title}").otherwise(f"Low {title}"))
        .drop("_median")
    )


def record_labels(df: DataFrame, order_by: list, label: str = "Sample Record", out: str = "entity") -> DataFrame:
    """``Sample Record #1``, ``#2``, ... in key order, for tables without an entity column."""
    return row_index(df, order_by, "_row").withColumn(
        out, F.concat(F.lit(f"{label} #"), F.col("_row").cast("string"))
    ).drop("_row")


def daily_dates_by_position(df: DataFrame, order_by: list, anchor: str, out: str = "date") -> DataFrame:
    """Row i gets the day ``anchor + i - 1``."""
    return row_index(df, order_by, "_row").withColumn(
        out, F.date_add(F.lit(anchor).cast("date"), (F.col("_row") - 1).cast("int"))
    ).drop("_row")


def linear_recency(df: DataFrame, order_by: list, first: float = 90.0, last: float = 1.0, out: str = "recency") -> DataFrame:
    """Evenly spaced values from ``first`` to ``last`` in key order."""
    indexed = row_index(df, order_by, "_row")
    total = F.broadcast(indexed.agg(F.count(F.lit(1)).alias("_n")))
    step = F.coalesce(F.try_divide(F.lit(last - first), (F.col("_n") - 1).cast("double")), F.lit(0.0))
    return indexed.crossJoin(total).withColumn(out, F.lit(first) + (F.col("_row") - 1) * step).drop("_row", "_n")
