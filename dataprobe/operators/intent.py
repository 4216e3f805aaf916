"""What a logged question asks for: limit, direction, aggregation, columns, chart, and whether it is on topic.

Every rule is a column expression, so a question log of any size is read once. The table asked about enters
only through its column names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.operators.profile import profile

# fixed values: words and their meaning
ASCENDING = ("lowest", "least", "bottom", "worst", "smallest", "min", "minimum", "fewer", "fewest", "lower", "drop")
AGGREGATION_WORDS = {
    "avg": ("average", "avg", "mean", "rate", "percentage", "ratio"),
    "count": ("count", "how many", "number of", "total orders", "order count"),
    "max": ("max", "maximum", "peak"),
    "min": ("min", "minimum"),
}
AVERAGED_METRICS = ("delay", "rate", "percent", "score", "ratio", "age", "rating", "satisfaction")
COUNTED_NOUNS = (
    "items", "records", "rows", "products", "customers", "departments", "categories", "states", "regions", "accounts", "cohorts",
    "segments",
)
DIMENSION_SYNONYMS = {
    "product": ("product", "products", "item", "items", "sku", "title", "goods", "merchandise"),
    "customer": ("customer", "customers", "client", "clients", "user", "users", "buyer", "buyers", "account", "accounts"),
    "state": ("state", "states", "province", "provinces"),
    "region": ("region", "regions", "zone", "zones", "territory", "area", "areas"),
    "city": ("city", "cities", "town", "metro"),
    "category": ("category", "categories", "segment", "segments", "group", "class", "genre"),
    "department": ("department", "departments", "dept", "team", "teams", "division", "divisions"),
    "channel": ("channel", "channels", "source", "medium"),
    "status": ("status", "stage", "condition"),
    "country": ("country", "nation"),
    "segment": ("segment", "segments", "cohort", "cohorts", "tier"),
}
METRIC_SYNONYMS = {
    "sales": ("sale", "sales", "revenue", "turnover", "income", "gmv", "amount"),
    "profit": ("profit", "profits", "margin", "earnings", "net"),
    "quantity": ("quantity", "quantities", "volume", "units", "ordered", "order_count"),
    "discount": ("discount", "discounts", "rate", "rebate"),
    "cost": ("cost", "costs", "expense", "expenses", "spend", "spending", "cpa", "cpc"),
    "delay": ("delay", "delays", "shipping", "delivery", "late"),
    "salary": ("salary", "salaries", "pay", "wage", "compensation"),
    "score": ("score", "rating", "performance", "kpi", "grade", "feedback"),
    "time": ("time", "hours", "duration", "wait"),
}
CHART_WORDS = (
    "chart", "graph", "plot", "visualize", "visualization", "visual", "diagram", "histogram", "pie", "donut", "doughnut", "scatter",
)
CHART_TYPES = {
    "pie": ("pie", "donut", "doughnut"),
    "scatter": ("scatter",),
    "line": ("line", "trend", "timeline", "over time", "run chart"),
    "bar": ("bar", "column"),
}
TEMPORAL_PARTS = ("date", "time", "day", "month", "year")
GREETINGS = ("hello", "hi", "hey", "help", "who are you", "what can you do")
VOCABULARY = (
    "top", "bottom", "highest", "lowest", "best", "worst", "most", "least", "average", "avg", "mean", "median", "sum",
    "total", "count", "number", "max", "min", "breakdown", "distribution", "trend", "correlation", "ranking", "rank",
    "ranks", "percentage", "percent", "rate", "ratio", "chart", "graph", "plot", "bar", "pie", "line", "scatter",
    "table", "outlier", "anomaly", "records", "record", "rows", "row", "data", "dataset", "metric", "column",
    "feature", "driver", "summary", "explain", "show", "give", "list", "compare", "performance", "pattern", "sale",
    "sales", "revenue", "profit", "cost", "price", "product", "item", "customer", "client", "buyer", "user", "order",
    "state", "region", "city", "country", "category", "department", "segment", "discount", "quantity", "volume",
    "unit", "units", "delay", "time", "date",
)
MAX_LIMIT, DEFAULT_LIMIT = 50, 10


@dataclass(frozen=True)
class Catalogue:
    """The columns a question may name."""

    categorical: list[str]
    dates: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    target: str | None = None

    @classmethod
    def of(cls, df: DataFrame, target: str | None = None, exact: bool = True) -> "Catalogue":
        rows = profile(df, exact).select("column_name", "is_categorical", "is_date", "is_numeric").collect()
        pick = lambda k: [r["column_name"] for r in rows if r[k]]
        return cls(pick("is_categorical"), pick("is_date"), pick("is_numeric"), target)

    @property
    def columns(self) -> list[str]:
        return self.categorical + self.dates + self.numeric


def _any(q: Column, words) -> Column:
    """Some word occurs anywhere in the text, also inside other words."""
    return q.rlike("|".join(re.escape(w) for w in words))


def normal(question: Column) -> Column:
    return F.lower(F.trim(question))


def words(q: Column) -> Column:
    return F.regexp_extract_all(q, F.lit(r"([a-zA-Z0-9_]+)"), F.lit(1))


def limit_of(q: Column) -> Column:
    ranked = F.regexp_extract(q, r"(?U)\b(?:top|first|highest|best|lowest|bottom|worst|limit)\s*(\d+)\b", 1)
    counted = F.regexp_extract(q, r"(?U)\b(\d+)\s*(?:" + "|".join(COUNTED_NOUNS) + r")\b", 1)
    # a number too long for an int is above any limit
    number = lambda s: F.greatest(F.lit(1), F.least(F.lit(MAX_LIMIT), F.coalesce(s.try_cast("int"), F.lit(MAX_LIMIT))))
    return (
        F.when(ranked != "", number(ranked))
        .when(counted != "", number(counted))
        .when(q.contains("20 best"), 20)
        .when(q.contains("10 best"), 10)
        .when(q.contains("5 best"), 5)
        .otherwise(DEFAULT_LIMIT)
    )


def direction_of(q: Column) -> Column:
    return F.when(_any(q, ASCENDING), "ASC").otherwise("DESC")


def aggregation_of(q: Column, metric: Column) -> Column:
    out = None
    for name, ws in AGGREGATION_WORDS.items():
        out = F.when(_any(q, ws), name) if out is None else out.when(_any(q, ws), name)
    return out.when(metric.isNull(), "count").when(_any(F.lower(metric), AVERAGED_METRICS), "avg").otherwise("sum")


def _direct(q: Column, ws: Column, column: str) -> Column:
    c = column.lower()
    return q.contains(c) | q.contains(c.replace("_", " ")) | F.arrays_overlap(ws, F.lit(c.split("_")))


def _choose(q: Column, ws: Column, columns: list[str], synonyms: dict[str, tuple[str, ...]], last: Column) -> Column:
    """First column named in the question, else the first column of the first concept both mention, else ``last``."""
    chain: list[tuple[Column, str]] = [(_direct(q, ws, c), c) for c in columns]
    for syns in synonyms.values():
        owner = next((c for c in columns if any(s in c.lower() for s in syns)), None)
        if owner:
            chain.append((_any(q, syns), owner))
    out = None
    for cond, name in chain:
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return last if out is None else out.otherwise(last)


def dimension_of(q: Column, ws: Column, cat: Catalogue) -> Column:
    asked = F.regexp_extract(q, r"(?U)\b(?:which|what)\s+([a-zA-Z0-9_]+)", 1)
    default = (cat.categorical + cat.dates)[:1]
    last = F.lit(default[0] if default else None).cast("string")
    for c in reversed(cat.categorical):
        near = (asked != "") & (F.lit(c.lower()).contains(asked) | asked.contains(c.lower()))
        last = F.when(near, F.lit(c)).otherwise(last)
    return _choose(q, ws, cat.categorical + cat.dates, DIMENSION_SYNONYMS, last)


def metric_of(q: Column, ws: Column, cat: Catalogue) -> Column:
    default = cat.target if cat.target in cat.numeric else (cat.numeric[0] if cat.numeric else None)
    return _choose(q, ws, cat.numeric, METRIC_SYNONYMS, F.lit(default).cast("string"))


def chart_of(q: Column, axis: Column) -> Column:
    """Requested chart type, or null. ``auto`` becomes line for a temporal axis, else bar."""
    asked = q.rlike(r"(?U)\b(?:" + "|".join(CHART_WORDS) + r")\b") | q.rlike(
        r"(?U)\b(?:bar|bars|line|lines|pie)\s+(?:chart|graph|plot|of)\b"
    )
    kind = None
    for name, ws in CHART_TYPES.items():
        kind = F.when(_any(q, ws), name) if kind is None else kind.when(_any(q, ws), name)
    auto = F.when(_any(F.lower(axis), TEMPORAL_PARTS), "line").otherwise("bar")
    return F.when(asked, kind.otherwise(auto))


def off_topic(q: Column, ws: Column, columns: list[str]) -> Column:
    """No words, or neither a column nor a word of the vocabulary; greetings are on topic."""
    parts = sorted({p for c in columns for p in c.lower().split("_") if len(p) > 2})
    named = _any(q, [c.lower() for c in columns]) if columns else F.lit(False)
    named = named | F.arrays_overlap(ws, F.lit(parts)) if parts else named
    known = F.arrays_overlap(ws, F.lit(list(VOCABULARY)))
    return (F.size(ws) == 0) | ~(q.isin(*GREETINGS) | named | known)


def intents(questions: DataFrame, cat: Catalogue, text: str = "question") -> DataFrame:
    """Add ``limit, direction, metric, dimension, aggregation, chart, off_topic`` to a question table."""
    q, ws = F.col("_q"), F.col("_w")
    base = questions.withColumn("_q", normal(F.col(text))).withColumn("_w", words(F.col("_q")))
    base = base.withColumn("metric", metric_of(q, ws, cat)).withColumn("dimension", dimension_of(q, ws, cat))
    return base.withColumns({
        "limit": limit_of(q), "direction": direction_of(q), "aggregation": aggregation_of(q, F.col("metric")),
        "chart": chart_of(q, F.col("dimension")), "off_topic": off_topic(q, ws, cat.columns),
    }).drop("_q", "_w")
