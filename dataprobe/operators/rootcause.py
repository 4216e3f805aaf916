"""Why a metric moved between two periods, and what sets a class apart.

All period sums are conditional aggregates over one tagged scan; per-value tables are reduced to the values
of a few low-cardinality dimensions before anything is compared.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.formatting import format_metric, title_case, title_text
from dataprobe.functions.numeric import as_double, half_even, pct_change, ratio
from dataprobe.operators import metrics, models
from dataprobe.operators.ordering import row_index
from dataprobe.operators.selection import first_rows
from dataprobe.operators.shape import columns_of, daily_dates_by_position, high_low_bins, parse_timestamp, tag_period
from dataprobe.scratch import materialise, spread

ID_PARTS = ("id", "uuid", "code")
DATE_PARTS = ("date", "time", "year")
FEATURE_ID_PARTS = ("id", "uuid", "code", "name", "unnamed")


# -------------------------------------------------------------------- periods

def with_periods(
    df: DataFrame, ts: str, order_by: list[str], start=None, end=None, share: float = 0.55
) -> DataFrame:
    """Add ``in_p1`` and ``in_p2``: before/within the given dates, or the first 55 % of the ordered rows and the rest.

    A side that the dates leave empty becomes the first or the second half of the rows. The tagged rows are
    written once, as every part of an investigation reads them.
    """
    rows = df.filter(F.col(ts).isNotNull())
    if start is None:
        return materialise(_positional(rows, order_by, share, {"in_p1", "in_p2"}), "periods")
    tag = tag_period(ts, start, end)
    sides = {"in_p1": F.coalesce(tag == "p1", F.lit(False)), "in_p2": F.coalesce(tag == "p2", F.lit(False))}
    tagged = materialise(rows.withColumns(sides), "periods")
    filled = tagged.agg(F.max("in_p1").alias("in_p1"), F.max("in_p2").alias("in_p2")).first()
    empty = {c for c in sides if not filled[c]}
    return materialise(_positional(tagged, order_by, 0.5, empty), "periods") if empty else tagged


def _positional(rows: DataFrame, order_by: list[str], share: float, sides: set[str]) -> DataFrame:
    total = rows.count()
    halves = first_rows(rows, order_by, max(1, math.floor(total * share)), total)
    cols = {"in_p1": F.col("_first"), "in_p2": ~F.col("_first")}
    return halves.withColumns({c: cols[c] for c in sides}).drop("_first")


def period_totals(tagged: DataFrame, ts: str, metric: str) -> DataFrame:
    """One row: active days, daily totals, their difference and percent change."""
    day = F.to_date(ts)
    in_ = lambda p, c: F.when(F.col(p), c)
    total = lambda p: F.coalesce(F.sum(in_(p, F.col(metric))).cast("double"), F.lit(0.0))
    row = tagged.agg(
        F.greatest(F.lit(1), F.count_distinct(in_("in_p1", day))).alias("p1_days"),
        F.greatest(F.lit(1), F.count_distinct(in_("in_p2", day))).alias("p2_days"),
        total("in_p1").alias("_t1"), total("in_p2").alias("_t2"),
    )
    row = row.select("p1_days", "p2_days", (F.col("_t1") / F.col("p1_days")).alias("p1_daily"), (F.col("_t2") / F.col("p2_days")).alias("p2_daily"))
    a, b = F.col("p1_daily"), F.col("p2_daily")
    return row.withColumn("delta", b - a).withColumn("pct_change", pct_change(a, b))


def usable_dimensions(df: DataFrame, least: int = 2, most: int = 30) -> list[str]:
    """All text columns that are no ids and have 2 to 30 distinct values."""
    dims = [c for c in columns_of(df, "string") if not models.is_id_like(c, ID_PARTS)]
    if not dims:
        return []
    levels = models.category_levels(df, dims, most)
    return [c for c in dims if c in levels and len(levels[c]) >= least]


def decompose(tagged: DataFrame, totals: DataFrame, metric: str, dims: list[str]) -> DataFrame:
    """``dimension, item, p1_daily, p2_daily, delta, pct_change, contribution``.

    Contribution is the item's share of all declines in its dimension; items that rose contribute 0.
    """
    keep = tagged.filter(F.col("in_p1") | F.col("in_p2")).select(
        *[F.col(d).cast("string").alias(d) for d in dims], F.col(metric).alias("_v"), "in_p1", "in_p2"
    )
    long = keep.unpivot(["_v", "in_p1", "in_p2"], dims, "dimension", "item").filter(F.col("item").isNotNull())
    part = lambda p: F.coalesce(F.sum(F.when(F.col(p), F.col("_v"))).cast("double"), F.lit(0.0))
    g = long.groupBy("dimension", "item").agg(part("in_p1").alias("s1"), part("in_p2").alias("s2"))
    days = F.broadcast(totals.select("p1_days", "p2_days"))
    d = g.crossJoin(days).select("dimension", "item", (F.col("s1") / F.col("p1_days")).alias("p1_daily"), (F.col("s2") / F.col("p2_days")).alias("p2_daily"))
    a, b = F.col("p1_daily"), F.col("p2_daily")
    d = d.withColumn("delta", b - a)
    pct = half_even((b - a) / F.when(a == 0, 1.0).otherwise(a) * 100, 1)
    declines = d.groupBy("dimension").agg(F.sum(F.when(F.col("delta") < 0, F.col("delta"))).alias("_falls"))
    d = d.join(declines, "dimension")
    falls = F.col("_falls")
    share = F.when((F.col("delta") < 0) & (falls < 0), half_even(F.col("delta") / falls * 100, 1)).otherwise(0.0)
    return d.withColumn("pct_change", pct).withColumn("contribution", share).drop("_falls")


def top_driver(items: DataFrame) -> DataFrame:
    """The item with the largest absolute change over all dimensions."""
    order = [F.abs("delta").desc(), F.col("dimension"), F.col("item")]
    return items.filter(F.col("delta") != 0).orderBy(*order).limit(1)


def best_correlated(df: DataFrame, metric: str) -> str:
    """The numeric column most correlated with the metric."""
    cols = [c for c in columns_of(df, "numeric") if c != metric and not models.is_id_like(c, ("id", "uuid", "unnamed"))]
    if not cols:
        raise ValueError("no numeric column besides the metric")
    found = models.correlation_with(df, F.col(metric), cols).filter("correlation IS NOT NULL").collect()  # one row per column
    r = {x["feature"]: abs(x["correlation"]) for x in found}
    return max(cols, key=lambda c: (r.get(c, -1.0), -cols.index(c)))


def numeric_fallback(tagged: DataFrame, totals: DataFrame, metric: str) -> DataFrame:
    """The same decomposition over High/Low halves of the most correlated number, for tables without dimensions."""
    best = best_correlated(tagged.drop("in_p1", "in_p2"), metric)
    binned = high_low_bins(tagged, best, out=best + "_bin")
    return decompose(binned, totals, metric, [best + "_bin"]).withColumn("dimension", F.lit(best))


def shifts(tagged: DataFrame, metrics_: list[str], least: float = 10.0) -> DataFrame:
    """``metric, p1_mean, p2_mean, pct_change, direction`` of other numbers that moved by 10 % or more."""
    mean = lambda p, c: F.avg(F.when(F.col(p), as_double(c)))
    row = tagged.agg(*[x for i, c in enumerate(metrics_) for x in (mean("in_p1", c).alias(f"a{i}"), mean("in_p2", c).alias(f"b{i}"))])
    structs = [F.struct(F.lit(c).alias("metric"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b")) for i, c in enumerate(metrics_)]
    long = row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    long = long.withColumn("pct_change", pct_change(F.col("a"), F.col("b"), 0.001))
    return long.filter(F.abs("pct_change") >= least).select(
        "metric", half_even(F.col("a"), 2).alias("p1_mean"), half_even(F.col("b"), 2).alias("p2_mean"), "pct_change",
        F.when(F.col("pct_change") > 0, "Increased").otherwise("Decreased").alias("direction"),
    )


def narrative(totals: DataFrame, driver: DataFrame, metric: str) -> DataFrame:
    """``what_happened, why_it_happened`` from the computed numbers."""
    title = title_text(metric)
    fell = F.col("delta") < 0
    money = lambda c: format_metric(F.lit(metric), F.col(c))
    what = F.concat(
        F.lit(f"{title} "), F.when(fell, "dropped").otherwise("increased"), F.format_string(" by %.1f%% ", F.abs("pct_change")),
        F.lit("(daily average from "), money("p1_daily"), F.lit(" to "), money("p2_daily"), F.lit(")."),
    )
    d = F.broadcast(
        driver.select(F.col("dimension").alias("_dim"), F.col("item").alias("_item"), F.col("pct_change").alias("_pct"))
    )
    why = F.when(F.col("_item").isNull(), F.lit(f"{title} moved without a leading segment.")).otherwise(
        F.concat(
            F.when(fell, "Main decline: '").otherwise("Main growth: '"), F.col("_item"), F.lit("' in "), title_case(F.col("_dim")),
            F.format_string(" changed by %+.1f%%.", "_pct"),
        )
    )
    return totals.join(d, F.lit(True), "left").select(what.alias("what_happened"), why.alias("why_it_happened"))


# -------------------------------------------------------------------- drivers

def _features(df: DataFrame, target: str, extra: tuple[str, ...] = ()) -> list[str]:
    return [c for c in df.columns if c != target and not c.startswith(extra or ("\0",)) and not models.is_id_like(c, FEATURE_ID_PARTS)]


def _usable(df: DataFrame, features: list[str]) -> list[str]:
    """The numbers and texts among the features; the others never enter a forest."""
    kinds = {*columns_of(df, "numeric"), *columns_of(df, "string")}
    return [c for c in features if c in kinds]


def _relation(r: Column) -> Column:
    return (
        F.when(r > 0.3, "strongly positively correlated")
        .when(r < -0.3, "strongly negatively correlated")
        .otherwise("empirically influential")
    )


def regression_drivers(
    df: DataFrame, metric: str, *, trees: int = 50, depth: int = 5, top: int = 5, seed: int = 42, key: list[str] | None = None
) -> DataFrame:
    """Top features of a forest for the metric with correlation and wording."""
    features = _usable(df, _features(df, metric, ("_dt", "in_p")))
    source, df = df, materialise(df.select(metric, *features), "rootcause-input")
    y = F.coalesce(as_double(metric), F.lit(0.0))
    frame, used = models.feature_frame(df, features, [y.alias("label")], max_levels=30)
    if not used:
        frame, used = _record_index(source, y, key)
    vec = models.forest_rows(materialise(frame, "rootcause"), used)
    rf = RandomForestRegressor(
        labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all"
    )
    fit = models.Fitted(rf.fit(vec), used, vec)
    numeric = [c for c in used if c in columns_of(df, "numeric")]
    best = fit.importances().orderBy(F.col("importance").desc(), "feature").limit(top)
    if numeric:
        corr = models.correlation_with(df, F.col(metric), numeric).withColumnRenamed("correlation", "r")
        best = best.join(F.broadcast(corr), "feature", "left")
    else:
        best = best.withColumn("r", F.lit(None).cast("double"))
    r = F.coalesce("r", F.lit(0.0))
    return best.withColumn("correlation", half_even(r, 2)).withColumn("relation", _relation(r)).drop("r")


def _record_index(df: DataFrame, label: Column, key: list[str] | None) -> tuple[DataFrame, list[str]]:
    """The position in key order (all columns unless given) as the only feature when nothing else remains."""
    rows = df.withColumn("label", label)
    return row_index(rows, key or df.columns, "_row").select("label", F.col("_row").cast("double").alias("x_record_index")), ["record_index"]


def positive_class(df: DataFrame, target: str) -> str:
    """The second value in order, or the only one."""
    value = F.col(target).cast("string").alias("v")
    values = [r["v"] for r in df.select(value).na.drop().distinct().orderBy("v").limit(2).collect()]
    if not values:
        raise ValueError(f"{target} has no classes")
    return values[-1]


def incidence(df: DataFrame, target: str, positive: str | None = None) -> DataFrame:
    """``positive_class, rows, positives, rate``."""
    rows = df.filter(F.col(target).isNotNull())
    positive = positive_class(rows, target) if positive is None else positive
    hit = F.col(target).cast("string") == positive
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(hit).alias("positives")).select(
        F.lit(positive).alias("positive_class"), "rows", "positives",
        half_even(ratio(F.col("positives"), F.greatest(F.col("rows"), F.lit(1))) * 100, 1).alias("rate"),
    )


def class_contrast(df: DataFrame, target: str, positive: str, columns: list[str]) -> DataFrame:
    """Mean of each number among positive and other rows with the percent difference."""
    hit = F.coalesce(F.col(target).cast("string") == positive, F.lit(False))
    rows = df.select(hit.alias("_hit"), *[as_double(c).alias(c) for c in columns])
    mean = lambda p, c: F.coalesce(F.avg(F.when(F.col("_hit") == p, F.col(c))), F.lit(0.0))
    row = rows.agg(*[x for i, c in enumerate(columns) for x in (mean(True, c).alias(f"a{i}"), mean(False, c).alias(f"b{i}"))])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b")) for i, c in enumerate(columns)]
    long = row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    diff = pct_change(F.col("b"), F.col("a"), 0.001)
    return long.select(
        "feature", half_even(F.col("a"), 4).alias("positive_mean"), half_even(F.col("b"), 4).alias("other_mean"), diff.alias("difference_percent"),
        F.when(diff > 0, "Elevated").otherwise("Suppressed").alias("direction"),
    )


def incidence_by(df: DataFrame, target: str, positive: str, dims: list[str]) -> DataFrame:
    """Rate of the positive class per value of each dimension, highest first."""
    hit = F.coalesce(F.col(target).cast("string") == positive, F.lit(False))
    long = (
        df.select(hit.alias("_hit"), *[F.col(d).cast("string").alias(d) for d in dims])
        .unpivot(["_hit"], dims, "dimension", "item")
        .filter(F.col("item").isNotNull())
    )
    g = long.groupBy("dimension", "item").agg(F.count(F.lit(1)).alias("rows"), F.count_if("_hit").alias("positives"))
    rate = half_even(ratio(F.col("positives"), F.col("rows")) * 100, 1)
    return g.withColumn("rate", rate).orderBy("dimension", F.col("rate").desc(), "item")


def classifier(
    df: DataFrame, target: str, *, trees: int = 60, depth: int = 6, top: int = 5, seed: int = 42, key: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """True in-sample metrics of a forest for the class, and its top features."""
    source, features = df.filter(F.col(target).isNotNull()), _usable(df, _features(df, target))
    # classes, levels, medians and features each read the rows
    rows = materialise(source.select(target, *features), "classifier-input")
    levels = models.class_levels(rows, target)
    code = models.class_codes(target, levels)
    frame, used = models.feature_frame(rows, features, [code], max_levels=30)
    if not used:
        frame, used = _record_index(source, code, key)
    frame = materialise(frame, "classifier")
    rf = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    model = rf.fit(models.forest_rows(frame, used))
    vec = models.assemble(spread(frame), used)
    scored = model.transform(vec).select("label", "prediction")
    score = metrics.binary_metrics(scored).drop("tp", "fp", "fn", "tn") if len(levels) <= 2 else metrics.weighted_metrics(scored)
    best = models.Fitted(model, used, vec).importances().orderBy(F.col("importance").desc(), "feature").limit(top)
    return score, best


def resolve_dates(df: DataFrame, ts: str | None, order_by: list[str], anchor: str = "2024-01-01", out: str = "resolved_date") -> DataFrame:
    """Add ``out``: the given column if more than 30 % of it parses as dates, else the first column whose name speaks
    of dates and does, else one day per row in key order from ``anchor`` on."""
    named = [c for c in df.columns if c != ts and contains_part(c, DATE_PARTS)]
    tries = [c for c in [ts, *named] if c in df.columns]
    if tries:
        share = df.agg(*[F.avg(_as_time(df, c).isNotNull().cast("int")).alias(f"s{i}") for i, c in enumerate(tries)]).first()
        for i, c in enumerate(tries):
            if (share[i] or 0) > 0.3:
                return df.withColumn(out, _as_time(df, c))
    return daily_dates_by_position(df, order_by, anchor, out)


def contains_part(name: str, parts: tuple[str, ...]) -> bool:
    return any(p in name.lower() for p in parts)


def _as_time(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.typeName()
    return F.col(c) if kind in ("date", "timestamp", "timestamp_ntz") else parse_timestamp(c) if kind == "string" else F.lit(None).cast("timestamp")


def class_dimensions(df: DataFrame, target: str, most: int = 10) -> list[str]:
    """Usable text columns, and numbers that take at most ten values."""
    texts = [c for c in usable_dimensions(df) if c != target]
    numbers = [c for c in columns_of(df, "numeric") if c != target and not models.is_id_like(c, ID_PARTS)]
    return texts + [c for c in numbers if models.few_values(df, c, most) is not None]


def class_narrative(target: str, rate: DataFrame, contrast: DataFrame, by: DataFrame | None) -> DataFrame:
    """``what_happened, why_it_happened`` of a class target: its rate, the number that differs most, and the value with
    the highest rate."""
    title = title_text(target)
    first = contrast.orderBy(F.abs("difference_percent").desc_nulls_last(), "feature").limit(1).select(title_case(F.col("feature")).alias("_f"), F.col("difference_percent").alias("_d"))
    row = rate.join(F.broadcast(first), F.lit(True), "left")
    why = F.when(F.col("_f").isNull(), F.lit("No number differs")).otherwise(F.concat(F.col("_f"), F.format_string(" differs by %+.1f%%", "_d")))
    why = F.concat(F.lit(f"{title} = "), F.col("positive_class"), F.lit(": "), why)
    if by is not None:
        top = by.orderBy(F.col("rate").desc(), "dimension", "item").limit(1).select(F.col("item").alias("_i"), title_case(F.col("dimension")).alias("_dim"), F.col("rate").alias("_r"))
        row = row.join(F.broadcast(top), F.lit(True), "left")
        why = F.concat(why, F.coalesce(F.concat(F.lit(", highest rate in '"), F.col("_i"), F.lit("' of "), F.col("_dim"), F.format_string(" (%.1f%%)", "_r")), F.lit("")))
    what = F.concat(F.lit(f"{title} outcome rate is "), F.format_string("%.1f%%", "rate"), F.lit(" across "), F.format_number("rows", 0), F.lit(" records."))
    return row.select(what.alias("what_happened"), F.concat(why, F.lit(".")).alias("why_it_happened"))


def explain(df: DataFrame, target: str, order_by: list[str], ts: str | None = None, start=None, end=None, *, with_models: bool = False) -> dict[str, DataFrame]:
    """The investigation that fits the target: of periods for numbers, of classes for texts and numbers of few values."""
    if models.is_numeric(df, target) and not models.is_classification(df, target):
        dated = resolve_dates(df, ts, order_by)
        return investigate(dated, target, "resolved_date", order_by, start, end)
    base = materialise(df.filter(F.col(target).isNotNull()), "classes")
    positive = positive_class(base, target)
    rate = incidence(base, target, positive)
    numbers = [c for c in columns_of(base, "numeric") if c != target and not models.is_id_like(c, ID_PARTS)]
    contrast = class_contrast(base, target, positive, numbers) if numbers else base.sparkSession.createDataFrame([], "feature string, difference_percent double")
    dims = class_dimensions(base, target)
    out = {"incidence": rate, "contrast": contrast}
    if dims:
        out["by_dimension"] = materialise(incidence_by(base, target, positive, dims), "by-dimension")
    out["narrative"] = class_narrative(target, rate, contrast, out.get("by_dimension"))
    if with_models:
        out["model"], out["features"] = classifier(base, target, key=order_by)
    return out


def investigate(
    df: DataFrame, metric: str, ts: str, order_by: list[str], start=None, end=None, dims: list[str] | None = None
) -> dict[str, DataFrame]:
    """All parts of a period investigation over one written, tagged table."""
    tagged = with_periods(df, ts, order_by, start, end)
    totals = materialise(period_totals(tagged, ts, metric), "totals")
    dims = usable_dimensions(tagged) if dims is None else dims
    items = decompose(tagged, totals, metric, dims) if dims else numeric_fallback(tagged, totals, metric)
    items = materialise(items, "items")
    driver = top_driver(items)
    others = [c for c in columns_of(df, "numeric") if c != metric and not models.is_id_like(c, ("id", "uuid", "unnamed"))]
    out = {"totals": totals, "items": items, "top_driver": driver, "narrative": narrative(totals, driver, metric)}
    if others:
        out["shifts"] = shifts(tagged, others)
    return out
