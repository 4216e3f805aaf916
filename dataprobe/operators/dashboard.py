"""The filtered dashboard: option lists, key figures, alerts and charts over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.operators import charts, kpi
from dataprobe.operators.aggregates import value_counts_by_column
from dataprobe.operators.ordering import ranked_within
from dataprobe.operators.profile import profile
from dataprobe.operators.shape import filter_equal
from dataprobe.scratch import materialise

OPTIONS = 15


def option_lists(df: DataFrame, columns: list[str], k: int = OPTIONS) -> DataFrame:
    """``column, option, position``: the first ``k`` distinct values of each column in order."""
    values = value_counts_by_column(df, columns).select("column", F.col("value").alias("option"))
    return ranked_within(values, ["column"], [F.col("option")], k, "position")


def dashboard(
    df: DataFrame, order_by: list[str], filters: dict | None = None, date_col: str | None = None, categorical: list[str] | None = None, exact: bool = True
) -> dict[str, DataFrame]:
    """All parts by name. Options come from the whole table; the filtered rows are written once for the rest.

    ``exact`` goes to the profile that finds categorical columns where none are named.
    """
    if categorical is None:
        categorical = [r["column_name"] for r in profile(df, exact).filter("is_categorical").select("column_name").collect()]
    rows = materialise(filter_equal(df, filters or {}), "dashboard")
    kpis = kpi.kpi_table_by_role(rows, date_col)
    out = {"kpis": kpis, "alerts": kpi.alerts(kpis), "row_count": rows.agg(F.count(F.lit(1)).alias("rows"))}
    if categorical:
        out["options"] = option_lists(df, categorical)
    return out | {f"chart_{k}": v for k, v in charts.automatic(rows, order_by).items()}
