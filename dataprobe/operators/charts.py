"""The aggregates behind charts: the row list of each chart is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataprobe.functions.formatting import format_short
from dataprobe.functions.numeric import half_even, ratio
from dataprobe.operators import roles
from dataprobe.operators.aggregates import AGGREGATIONS, daily_rollup, value_counts
from dataprobe.operators.ordering import last_n
from dataprobe.operators.series import first_to_last
from dataprobe.operators.shape import columns_of


def trend(df: DataFrame, date: str, metric: str, points: int = 60) -> DataFrame:
    """``date, value``: daily sums of the last ``points`` days."""
    return last_n(daily_rollup(df, date, metric).select("date", F.col("sum_val").alias("value")), points, "date")


def trend_takeaway(points: DataFrame) -> DataFrame:
    """First and last value with the change between them and its direction."""
    ends = first_to_last(points, "value")
    return ends.withColumn("direction", F.when(F.col("change_percent") >= 0, "increased").otherwise("declined"))


def ranked_sum(df: DataFrame, dim: str, metric: str, k: int) -> DataFrame:
    """``label, value``: top ``k`` by sum, null labels dropped, ties by label."""
    g = df.filter(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("label")).agg(F.sum(metric).cast("double").alias("value"))
    return g.orderBy(F.col("value").desc_nulls_last(), "label").limit(k)


def breakdown_takeaway(shown: DataFrame) -> DataFrame:
    """Leader with its share of the shown rows, and the laggard among them."""
    key = lambda sign: F.struct((sign * F.col("value")).alias("v"), F.col("label").alias("l"))
    total = F.sum("value")
    top = F.min(key(-1))
    low = F.max(F.struct((-F.col("value")).alias("v"), F.col("label").alias("l")))
    return shown.agg(
        top["l"].alias("leader"), format_short(-top["v"]).alias("leader_value"),
        half_even(ratio(-top["v"], total) * 100, 1).alias("leader_share"),
        low["l"].alias("laggard"), format_short(-low["v"]).alias("laggard_value"),
    )


def share(df: DataFrame, dim: str, metric: str, k: int = 6) -> DataFrame:
    """Top ``k`` with their share of the shown total; at most ``k`` rows meet in the second step."""
    shown = ranked_sum(df, dim, metric, k)
    total = shown.agg(F.sum("value").alias("_t"))
    return shown.crossJoin(F.broadcast(total)).select(
        "label", "value", half_even(ratio(F.col("value"), F.col("_t")) * 100, 1).alias("share")
    )


def scatter(df: DataFrame, x: str, y: str, order_by: list, n: int = 80) -> DataFrame:
    """The first ``n`` complete pairs in key order."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return pairs.orderBy(*order_by).limit(n).select(F.col(x).alias("x"), F.col(y).alias("y"))


def risk_by(df: DataFrame, dim: str, metric: str, k: int = 8) -> DataFrame:
    """Top ``k`` by mean of a risk metric."""
    g = df.filter(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("label")).agg(half_even(F.avg(metric).cast("double"), 2).alias("value"))
    return g.orderBy(F.col("value").desc_nulls_last(), "label").limit(k)


def value_list(df: DataFrame, column: str, order_by: list, n: int = 30) -> DataFrame:
    """The first ``n`` values in key order with their place."""
    top = df.orderBy(*order_by).limit(n)
    return top.select(F.row_number().over(Window.orderBy(*order_by)).alias("category"), F.col(column).alias("value"))


def custom(df: DataFrame, x: str, y: str | None = None, aggregation: str = "none", order_by: list | None = None) -> DataFrame:
    """Raw pairs (40), distribution of ``x`` (20), or an aggregate of ``y`` by ``x`` (20)."""
    raw = aggregation == "none" or not y or y == x
    if raw and y and y != x:
        pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).orderBy(*(order_by or [x, y])).limit(40)
        return pairs.select(F.col(x).alias("label"), F.col(y).alias("value"))
    g = df.groupBy(F.col(x).alias("label"))
    if raw or aggregation == "count":
        out = g.agg(F.count(F.lit(1)).alias("value"))
    else:
        out = g.agg(AGGREGATIONS.get(aggregation, F.sum)(y).cast("double").alias("value"))
    return out.orderBy(F.col("value").desc_nulls_last(), F.col("label").asc_nulls_last()).limit(20)


def automatic(df: DataFrame, order_by: list[str], limit: int = 6) -> dict[str, DataFrame]:
    """Up to six charts by column roles, filled with counts and value lists."""
    r = roles.chart_roles(df)
    numbers, texts = roles.without_ids(columns_of(df, "numeric")), roles.without_ids(columns_of(df, "string"))
    out: dict[str, DataFrame] = {}
    metric, dim = r["metric"], r["dimension"]
    if r["date"] and metric:
        out["trend_over_time"] = trend(df, r["date"], metric)
    if dim and metric:
        out["category_breakdown"] = ranked_sum(df, dim, metric, 10)
    if metric and (r["second"] or dim):
        out["share_composition"] = share(df, r["second"] or dim, metric)
    if len(numbers) >= 2:
        out["scatter_relationship"] = scatter(df, numbers[0], numbers[1], order_by)
    if r["risk"] and dim:
        out["risk_efficiency_metric"] = risk_by(df, dim, r["risk"])
    if r["ranking"] and metric:
        out["entity_ranking"] = ranked_sum(df, r["ranking"], metric, 10)
    spare = [("fallback_counts_" + c, c, True) for c in texts] + [("fallback_values_" + c, c, False) for c in numbers]
    for name, c, counts in spare:
        if len(out) >= limit:
            break
        out[name] = value_counts(df, c, 8) if counts else value_list(df, c, order_by)
    return dict(list(out.items())[:limit])
