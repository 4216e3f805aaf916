"""Text formatting of metric names and values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: name parts that mark a money column
CURRENCY_WORDS = (
    "revenue", "sales", "profit", "spend", "cost", "price", "amount",
    "unit_price", "total_amount", "treatment_cost", "mrr", "arr", "mrr_generated",
)
RATE_WORDS = ("rate", "pct", "percent", "discount")
MEASURE_WORDS = ("age", "days", "delay", "time", "count", "quantity", "score")


def title_case(c: Column) -> Column:
    """``order_date`` -> ``Order Date``."""
    return F.initcap(F.translate(c, "_", " "))


def title_text(name: str) -> str:
    return name.replace("_", " ").title()


def contains_any(name: Column, words) -> Column:
    return name.rlike("|".join(w.replace("$", r"\$") for w in words))


def is_currency(name: Column) -> Column:
    return contains_any(F.lower(name), CURRENCY_WORDS + ("$",))


def has_dollar_header(columns) -> bool:
    """True when some header carries a dollar sign."""
    return any("$" in c for c in columns)


def _thousands(v: Column, digits: int) -> Column:
    return F.format_number(v, digits)


def money(v: Column, dollar: bool | Column = False) -> Column:
    prefix = F.when(F.lit(dollar) if isinstance(dollar, bool) else dollar, "$").otherwise("")
    return F.concat(F.when(v < 0, "-").otherwise(""), prefix, _thousands(F.abs(v), 2))


def format_metric(name: Column, value: Column, is_avg: bool | Column = False, dollar: bool | Column = False) -> Column:
    """Value as text, the unit chosen by the metric's name."""
    n, v = F.lower(name), value.cast("double")
    avg = F.lit(is_avg) if isinstance(is_avg, bool) else is_avg
    whole = v == F.floor(v)
    return (
        F.when(is_currency(n), money(v, dollar))
        .when(
            contains_any(n, RATE_WORDS),
            F.concat(F.when(v <= 1.0, F.format_string("%.1f", v * 100)).otherwise(F.format_string("%.1f", v)), F.lit("%")),
        )
        .when(contains_any(n, MEASURE_WORDS) & contains_any(n, ("day", "delay")), F.format_string("%.1f days", v))
        .when(n.contains("score") & (v <= 10), F.format_string("%.1f / 10", v))
        .when(contains_any(n, MEASURE_WORDS) & avg, _thousands(v, 1))
        .when(contains_any(n, MEASURE_WORDS) & whole, _thousands(v, 0))
        .otherwise(_thousands(v, 2))
    )


def format_short(value: Column, dollar: bool | Column = False) -> Column:
    """Whole numbers without decimals, null as "0"."""
    v = value.cast("double")
    prefix = F.when(F.lit(dollar) if isinstance(dollar, bool) else dollar, "$").otherwise("")
    return (
        F.when(v.isNull(), "0")
        .when(v < 0, F.concat(F.lit("-"), prefix, _thousands(F.abs(v), 2)))
        .when(v == F.floor(v), F.concat(prefix, _thousands(v, 0)))
        .otherwise(F.concat(prefix, _thousands(v, 2)))
    )


def format_delta(value: Column) -> Column:
    """Two decimals with an explicit plus sign."""
    v = value.cast("double")
    return F.concat(F.when(v > 0, "+").when(v < 0, "-").otherwise(""), _thousands(F.abs(v), 2))
