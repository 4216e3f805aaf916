"""Key figures with half-over-half change, and the alerts they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.formatting import format_metric, has_dollar_header, title_text
from dataprobe.functions.numeric import half_even, pct_change
from dataprobe.operators import roles
from dataprobe.operators.series import split_at_quantile

# fixed values: efficiency columns that are averaged, not summed
AVERAGED = ("roi", "satisfaction_score", "discount")


def with_halves(df: DataFrame, date_col: str | None, min_share: float = 0.5) -> DataFrame:
    """Tag rows before and from the median date; without enough dates no row gets a period."""
    none = F.lit(None).cast("string")
    if date_col is None:
        return df.withColumn("period", none)
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.count(date_col).alias("dated")).first()
    if facts["dated"] <= facts["rows"] * min_share:
        return df.withColumn("period", none)
    return split_at_quantile(df, date_col, 0.5, rows=facts["rows"])


def _rec(kpi: str, title: Column, value: Column, raw: Column, delta: Column, rising_is_good: bool) -> Column:
    good = delta >= 0 if rising_is_good else delta <= 0
    return F.struct(
        F.lit(kpi).alias("kpi"), title.alias("title"), value.alias("value"), raw.cast("double").alias("raw_value"),
        delta.cast("double").alias("delta_percent"), F.coalesce(good, F.lit(True)).alias("is_positive"),
    )


def kpi_table(
    df: DataFrame,
    date_col: str | None = None,
    *,
    monetary: str | None = None,
    efficiency: str | None = None,
    risk: str | None = None,
    dollar: bool | None = None,
) -> DataFrame:
    """Up to four rows: records, monetary sum, efficiency, risk rate. One aggregate over the table."""
    dollar = has_dollar_header(df.columns) if dollar is None else dollar
    wanted = [c for c in (monetary, efficiency, risk) if c]
    slim = df.select(*([F.col(date_col).alias("_date")] if date_col else []), *[F.col(c) for c in dict.fromkeys(wanted)])
    rows = with_halves(slim, "_date" if date_col else None)
    in_ = lambda p, c: F.when(F.col("period") == p, F.col(c))
    aggs = [
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("period") == "p1").alias("n1"), F.count_if(F.col("period") == "p2").alias("n2")
    ]
    for tag, c in (("m", monetary), ("e", efficiency), ("r", risk)):
        if c:
            mean = tag == "r" or (tag == "e" and c.lower() in AVERAGED)
            f = F.avg if mean else F.sum
            aggs += [f(c).cast("double").alias(tag), f(in_("p1", c)).cast("double").alias(tag + "1"), f(in_("p2", c)).cast("double").alias(tag + "2")]
    row = rows.agg(*aggs)
    n = F.col("n")
    recs = [
        _rec(
            "total_records", F.lit("Total Records"), F.format_number(n, 0), n,
            F.when(F.col("n1") > 0, pct_change(F.col("n1"), F.col("n2"))), True,
        )
    ]
    if monetary:
        recs.append(
            _rec(
                "primary_monetary", F.lit(f"Total {title_text(monetary)}"), format_metric(F.lit(monetary), F.col("m"), dollar=dollar),
                half_even(F.col("m"), 2), pct_change(F.col("m1"), F.col("m2")), True,
            )
        )
    if efficiency:
        mean = efficiency.lower() in AVERAGED
        text = F.format_string("%.2fx", F.col("e")) if efficiency.lower() == "roi" else format_metric(
            F.lit(efficiency), F.col("e"), is_avg=mean, dollar=dollar
        )
        recs.append(
            _rec(
                "primary_efficiency", F.lit(f"{'Average' if mean else 'Total'} {title_text(efficiency)}"), text,
                half_even(F.col("e"), 4 if mean else 2), pct_change(F.col("e1"), F.col("e2"), 0.001 if mean else 1.0), True,
            )
        )
    if risk:
        share = F.col("r") <= 1
        title = F.when(share, f"{title_text(risk)} Rate").otherwise(f"Avg {title_text(risk)}")
        text = F.when(share, F.format_string("%.1f%%", F.col("r") * 100)).otherwise(F.format_string("%.2f days", F.col("r")))
        recs.append(
            _rec("critical_risk", title, text, half_even(F.col("r"), 3), pct_change(F.col("r1"), F.col("r2"), 0.001), False)
        )
    return row.filter("n > 0").select(F.explode(F.array(*recs)).alias("s")).select("s.*")


def kpi_table_by_role(df: DataFrame, date_col: str | None = None, dollar: bool | None = None) -> DataFrame:
    """The same with columns found by name."""
    return kpi_table(
        df, date_col, monetary=roles.pick(df, roles.KPI_MONETARY, numeric=True),
        efficiency=roles.pick(df, roles.KPI_EFFICIENCY, numeric=True), risk=roles.pick(df, roles.KPI_RISK, numeric=True), dollar=dollar,
    )


def alerts(kpis: DataFrame, risk_rise: float = 20.0, value_drop: float = -10.0) -> DataFrame:
    """``kpi, level, title``: risk up by more than 20 %, money or efficiency down by more than 10 %."""
    d = F.col("delta_percent")
    danger = (F.col("kpi") == "critical_risk") & (d > risk_rise)
    warning = F.col("kpi").isin("primary_monetary", "primary_efficiency") & (d < value_drop)
    return kpis.filter(danger | warning).select(
        "kpi",
        F.when(danger, "danger").otherwise("warning").alias("level"),
        F.when(danger, F.format_string("Operational Alert: Surge in %s", "title"))
        .otherwise(F.format_string("Performance Drop: %s Down %.1f%%", F.col("title"), F.abs(d)))
        .alias("title"),
        d.alias("delta_percent"),
    )
