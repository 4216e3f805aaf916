"""Positions in a total order, without pulling the rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataprobe.scratch import materialise

_SPLIT_BITS = 33  # monotonically_increasing_id keeps the position in the low 33 bits


def range_split(df: DataFrame, order_by: list[Column | str]) -> DataFrame:
    """Rows range-split on the whole key and written once, with split number and position in the split.

    The whole key is used so that a hot leading value still spreads over splits. Writing fixes the splits:
    every later reader, and every re-run of a lost task, sees the same ones.
    """
    keys = [F.col(k).asc_nulls_last() if isinstance(k, str) else k for k in order_by]
    split = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    split = materialise(split.withColumn("_id", F.monotonically_increasing_id()), "ranged")
    return split.select(
        *df.columns,
        F.shiftright("_id", _SPLIT_BITS).alias("_split"),
        F.col("_id").bitwiseAND((1 << _SPLIT_BITS) - 1).alias("_pos"),
    )


def row_index(df: DataFrame, order_by: list[Column | str], name: str = "row_index") -> DataFrame:
    """Add the 1-based position of each row in the order of ``order_by`` (ends in a unique key).

    Split sizes, one row per split, turn into offsets that are small enough to broadcast.
    """
    split = range_split(df, order_by)
    sizes = split.groupBy("_split").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return split.join(F.broadcast(offsets), "_split").select(
        *df.columns, (F.col("_before") + F.col("_pos") + 1).cast("long").alias(name)
    )


def running_total(df: DataFrame, order_by: list[Column | str], columns: list[str], prefix: str = "upto_") -> DataFrame:
    """Inclusive running sums in key order over the whole table."""
    split = range_split(df, order_by)
    here = Window.partitionBy("_split").orderBy("_pos")
    sums = split.groupBy("_split").agg(*[F.sum(c).alias(c) for c in columns])
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_split", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b_{c}") for c in columns])
    return (
        split.withColumns({f"_r_{c}": F.sum(c).over(here) for c in columns})
        .join(F.broadcast(offsets), "_split")
        .select(*df.columns, *[(F.col(f"_r_{c}") + F.col(f"_b_{c}")).alias(prefix + c) for c in columns])
    )


def fill_both_ways(df: DataFrame, columns: list[str], order_by: list[Column | str]) -> DataFrame:
    """Forward fill, then backward fill what is left, in key order over the whole table.

    Filled inside each split first; each split's first and last known values then carry over to its
    neighbours, one row per split.
    """
    split = range_split(df, order_by)
    back = Window.partitionBy("_split").orderBy("_pos")
    # reading backwards keeps a running frame; a frame to unbounded following is rebuilt for every row
    ahead = Window.partitionBy("_split").orderBy(F.col("_pos").desc())
    ends = split.groupBy("_split").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(f"_last_{c}") for c in columns],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(f"_first_{c}") for c in columns],
    )
    earlier = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.col("_split").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "_split",
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_prev_{c}") for c in columns],
        *[F.last(f"_first_{c}", ignorenulls=True).over(later).alias(f"_next_{c}") for c in columns],
    )
    filled = split.select(
        "*",
        *[F.last(c, ignorenulls=True).over(back).alias(f"_back_{c}") for c in columns],
        *[F.last(c, ignorenulls=True).over(ahead).alias(f"_ahead_{c}") for c in columns],
    ).join(F.broadcast(carried), "_split")
    value = lambda c: F.coalesce(f"_back_{c}", f"_prev_{c}", f"_ahead_{c}", f"_next_{c}").alias(c)
    return filled.select(*[value(c) if c in columns else F.col(c) for c in df.columns])


def quantile_bin(position: Column, total: Column, q: Column | int) -> Column:
    """Bin 0..q-1 of the row at ``position`` (1-based) among ``total``: right-closed quantile edges."""
    q = F.lit(q) if isinstance(q, int) else q
    raw = F.ceil(F.try_divide((position - 1) * q, (total - 1).cast("double"))) - 1
    return F.greatest(F.lit(0), F.least(q - 1, F.coalesce(raw, F.lit(0)))).cast("int")


def first_n(df: DataFrame, n: int, order_by: list[Column | str]) -> DataFrame:
    """The first ``n`` rows in key order (a top-k, never a full sort)."""
    return df.orderBy(*order_by).limit(n)


def last_n(df: DataFrame, n: int, key: str) -> DataFrame:
    """The last ``n`` rows in key order, given back ascending."""
    return df.orderBy(F.col(key).desc_nulls_last()).limit(n).orderBy(key)


def top_k(df: DataFrame, value: str, label: str, k: int, ascending: bool = False) -> DataFrame:
    """Top or bottom ``k`` rows by value, nulls last, ties by label."""
    v = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    return df.orderBy(v, F.col(label).asc_nulls_last()).limit(k)


def ranked_within(df: DataFrame, group: list[str], order_by: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows of each group; Spark limits per task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order_by)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
