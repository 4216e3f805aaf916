"""Cleaning: dedupe, rename, impute, parse dates, flag outliers, write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.numeric import as_double, sample_skewness
from dataprobe.operators.aggregates import modes
from dataprobe.operators.ordering import fill_both_ways
from dataprobe.operators.profile import profile
from dataprobe.operators.quality import fences
from dataprobe.operators.quantiles import median_row, quantile_row
from dataprobe.operators.shape import parse_timestamp, sanitise_columns
from dataprobe.scratch import materialise
from dataprobe.sources.sinks import write_parquet


def numeric_fill_values(df: DataFrame, columns: list[str], **kw) -> DataFrame:
    """One row; per column the median when |skew| > 1, else the mean, with the method's name."""
    stats = df.agg(
        *[sample_skewness(c).alias(f"s_{c}") for c in columns], *[F.avg(as_double(c)).alias(f"a_{c}") for c in columns]
    )
    med = median_row(df, columns, **kw)
    both = stats.crossJoin(F.broadcast(med))
    cols = []
    for c in columns:
        skewed = F.coalesce(F.abs(f"s_{c}") > 1.0, F.lit(False))
        cols += [
            F.when(skewed, F.col(c)).otherwise(F.col(f"a_{c}")).alias(f"_f_{c}"),
            F.when(skewed, "median").otherwise("mean").alias(f"_w_{c}"),
        ]
    return both.select(*cols)


def impute_numeric(df: DataFrame, columns: list[str], **kw) -> DataFrame:
    """Fill missing numbers; the columns become double."""
    if not columns:
        return df
    fill = numeric_fill_values(df, columns, **kw).select(*[f"_f_{c}" for c in columns])
    filled = {c: F.coalesce(as_double(c), F.col(f"_f_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(fill)).select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def categorical_fill_values(df: DataFrame, columns: list[str], max_missing: float = 0.05) -> dict[str, str]:
    """Per column the mode when fewer than 5 % are missing, else ``Unknown``."""
    if not columns:
        return {}
    rows = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns]).first()
    top = {r["column"]: r["mode"] for r in modes(df, columns).collect()}
    share = {c: (rows["n"] - rows[c]) / max(rows["n"], 1) for c in columns}
    return {c: top[c] if c in top and share[c] < max_missing else "Unknown" for c in columns}


def impute_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.fill(categorical_fill_values(df, columns)) if columns else df


def impute_dates(df: DataFrame, columns: list[str], order_by: list) -> DataFrame:
    """Forward then backward fill in key order."""
    return fill_both_ways(df, columns, order_by) if columns else df


def flag_outliers(df: DataFrame, columns: list[str], min_rows: int = 15, **kw) -> DataFrame:
    """Add ``<column>_outlier``; no row is removed."""
    if not columns:
        return df
    q = quantile_row(df, columns, [0.25, 0.75], **kw).select(*[F.col(c).alias(f"_q_{c}") for c in columns])
    known = df.agg(*[F.count(as_double(c)).alias(f"_n_{c}") for c in columns])
    both = df.crossJoin(F.broadcast(q.crossJoin(known)))
    flags = {}
    for c in columns:
        iqr, lo, hi = fences(F.col(f"_q_{c}"))
        v = as_double(c)
        flags[f"{c}_outlier"] = F.coalesce((F.col(f"_n_{c}") >= min_rows) & (iqr > 0) & ((v < lo) | (v > hi)), F.lit(False))
    return both.withColumns(flags).select(*df.columns, *flags)


def clean(
    df: DataFrame,
    order_by: list[str],
    *,
    remove_duplicates: bool = True,
    impute_missing: bool = True,
    mark_outliers: bool = True,
    output: str | None = None,
    exact: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The cleaned table and a one-row report. ``order_by`` names the cleaned columns that order the rows,
    ``exact`` goes to the profile."""
    spark = df.sparkSession
    original = df.count()
    base = sanitise_columns(df.dropDuplicates() if remove_duplicates else df)
    base = materialise(base, "clean-base")  # several passes read it
    facts = profile(base, exact).select("column_name", "detected_type", "missing_count", "rows", "family").collect()
    rows = facts[0]["rows"] if facts else 0
    pick = lambda *kinds: [r["column_name"] for r in facts if r["detected_type"] in kinds]
    missing = {r["column_name"] for r in facts if r["missing_count"] > 0}
    numeric, cats, dates = pick("integer", "float"), pick("categorical"), pick("datetime")
    text_dates = [r["column_name"] for r in facts if r["detected_type"] == "datetime" and r["family"] == "string"]
    out, notes = base, []
    if impute_missing:
        gaps = [c for c in numeric if c in missing]
        if gaps:
            how = numeric_fill_values(base, gaps, rows=rows).first()
            notes += [f"{c}: {how[f'_w_{c}']} ({how[f'_f_{c}']:.2f})" for c in gaps]
            out = out.select(
                *[F.coalesce(as_double(c), F.lit(how[f"_f_{c}"])).alias(c) if c in gaps else F.col(c) for c in out.columns]
            )
        gaps = [c for c in cats if c in missing]
        if gaps:
            values = categorical_fill_values(base, gaps)
            notes += [f"{c}: '{v}'" for c, v in values.items()]
            out = out.na.fill(values)
        gaps = [c for c in dates if c in missing]
        if gaps:
            notes += [f"{c}: forward/backward fill" for c in gaps]
            out = impute_dates(out, gaps, order_by)
    out = out.withColumns({c: parse_timestamp(c) for c in text_dates}) if text_dates else out
    flagged = 0
    if mark_outliers and numeric:
        out = materialise(out, "clean-filled")
        out = flag_outliers(out, numeric, rows=rows)
        flagged = out.agg(sum((F.count_if(f"{c}_outlier") for c in numeric), F.lit(0))).first()[0]
    if output:
        out = spark.read.parquet(write_parquet(out, output))
    report = spark.createDataFrame(
        [(original, rows, original - rows, sorted(notes), int(flagged))],
        "original_rows long, processed_rows long, duplicates_removed long, imputed array<string>, outliers_flagged long",
    )
    return out, report
