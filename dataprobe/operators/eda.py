"""Descriptive statistics, histograms, correlations and category counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.numeric import as_double, half_even, sample_std
from dataprobe.operators.aggregates import value_counts_by_column
from dataprobe.operators.models import is_id_like
from dataprobe.operators.ordering import ranked_within
from dataprobe.operators.quantiles import quantile_row
from dataprobe.operators.shape import columns_of


def summary(df: DataFrame, columns: list[str] | None = None, digits: int = 2, **kw) -> DataFrame:
    """``column, count, mean, std, min, q25, median, q75, max`` per numeric column."""
    columns = columns or columns_of(df, "numeric")
    values = df.select(*[as_double(c).alias(c) for c in columns]).unpivot([], columns, "column", "v")
    facts = values.filter(F.col("v").isNotNull()).groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), sample_std("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    q = quantile_row(df, columns, [0.25, 0.5, 0.75], **kw).unpivot([], columns, "column", "q")
    r = lambda c: half_even(c, digits)
    return facts.join(F.broadcast(q), "column").select(
        "column", "count", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), r(F.col("min")).alias("min"),
        r(F.col("q")[0]).alias("q25"), r(F.col("q")[1]).alias("median"), r(F.col("q")[2]).alias("q75"), r(F.col("max")).alias("max"),
    )


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 10) -> DataFrame:
    """``column, bin, lo, hi, count``: equal-width bins from minimum to maximum, the last one closed.

    A constant column is widened by half a unit to each side. Empty bins are kept.
    """
    columns = columns or columns_of(df, "numeric")
    values = df.select(*[as_double(c).alias(c) for c in columns]).unpivot([], columns, "column", "v")
    values = values.filter(F.col("v").isNotNull())
    ends = values.groupBy("column").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    flat = F.col("a") == F.col("b")
    ends = ends.select(
        "column", F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"),
        F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"),
    )
    place = F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * bins)
    counts = (
        values.join(F.broadcast(ends), "column")
        .groupBy("column", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    edge = lambda k: half_even(F.col("a") + (F.col("b") - F.col("a")) * k / bins, 1)
    return grid.join(counts, ["column", "bin"], "left").select(
        "column", "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def _moments(values: DataFrame, centre: list[float]) -> DataFrame:
    """``i, j, n, a, b, aa, bb, ab`` per pair and task: number and sums of the values, less ``centre``, where both are known."""
    k = len(centre)
    at = np.array(centre)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two, cross = (np.zeros((k, k)) for _ in range(4))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - at
            known = np.isfinite(x)
            x = np.where(known, x, 0.0)
            m = known.astype(float)
            n += m.T @ m
            one += x.T @ m
            two += (x * x).T @ m
            cross += x.T @ x
        i, j = np.nonzero(np.triu(n))
        out = [i.astype(np.int32), j.astype(np.int32), n[i, j], one[i, j], one[j, i], two[i, j], two[j, i], cross[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], ["i", "j", "n", "a", "b", "aa", "bb", "ab"])

    return values.mapInArrow(scan, "i int, j int, n double, a double, b double, aa double, bb double, ab double")


#: a part of the second moment; variances below it are rounding, the column is constant
NO_SPREAD = 1e-12


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``i, j, x, y, r`` for every unordered pair of numeric columns, itself included.

    Each task multiplies its batches with their masks of known values and gives one record of moments per pair, so
    what is shuffled does not grow with the rows. The moments are taken around the columns' means, found by one
    aggregate before. Values that are not finite count as missing; a pair without spread has no ``r`` and is left out.
    """
    columns = columns or columns_of(df, "numeric")
    if not columns:
        return df.sparkSession.createDataFrame([], "i int, j int, x string, y string, r double")
    names = F.lit(columns)
    values = df.select(*[as_double(c).alias(f"c{i}") for i, c in enumerate(columns)])
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))  # noqa: E731  Spark sorts NaN above infinity
    means = values.agg(*[F.avg(finite(c)).alias(c) for c in values.columns]).first()
    centre = [m if m is not None and math.isfinite(m) else 0.0 for m in means]
    g = _moments(values, centre).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")])
    va, vb = F.col("aa") - F.col("a") * F.col("a") / F.col("n"), F.col("bb") - F.col("b") * F.col("b") / F.col("n")
    spread = (va > F.col("aa") * NO_SPREAD) & (vb > F.col("bb") * NO_SPREAD)
    r = (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / (F.sqrt(va) * F.sqrt(vb))
    out = g.filter(spread).select("i", "j", F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)).alias("r"))
    return out.select("i", "j", F.get(names, F.col("i")).alias("x"), F.get(names, F.col("j")).alias("y"), "r")


def correlations(df: DataFrame, columns: list[str] | None = None, digits: int = 2) -> DataFrame:
    """The full matrix in long form, undefined entries left out."""
    p = correlation_pairs(df, columns)
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("x", "y"))).otherwise(
        F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    )
    return p.select(F.explode(both).alias("p"), half_even(F.col("r"), digits).alias("correlation")).select("p.x", "p.y", "correlation")


def strong_pairs(df: DataFrame, least: float = 0.4, k: int = 8, columns: list[str] | None = None) -> DataFrame:
    """The first ``k`` pairs in column order with |r| of at least ``least``; id-like columns are left out."""
    columns = columns or [c for c in columns_of(df, "numeric") if not is_id_like(c, ("id", "uuid", "code"))]
    p = correlation_pairs(df, columns).filter((F.col("i") < F.col("j")) & (F.abs("r") >= least))
    return p.orderBy("i", "j").limit(k).select("x", "y", half_even(F.col("r"), 2).alias("correlation"))


def category_counts(df: DataFrame, columns: list[str] | None = None, max_distinct: int = 30, k: int = 8) -> DataFrame:
    """Top values of each text column with few distinct values: ``column, category, count, rank``."""
    columns = columns or columns_of(df, "string")
    counts = value_counts_by_column(df, columns)
    small = counts.groupBy("column").agg(F.count(F.lit(1)).alias("_d")).filter(F.col("_d") <= max_distinct).select("column")
    kept = counts.join(F.broadcast(small), "column")  # one row per column
    top = ranked_within(kept, ["column"], [F.col("count").desc(), F.col("value")], k)
    return top.select("column", F.col("value").alias("category"), "count", "rank")
