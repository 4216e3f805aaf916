"""Labels, features, splits and tree models on MLlib."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.functions.formatting import title_text
from dataprobe.functions.ladders import ladder
from dataprobe.functions.numeric import as_double, half_even
from dataprobe.operators import forest, metrics
from dataprobe.operators.aggregates import distinct_counts, value_counts_by_column
from dataprobe.operators.ordering import ranked_within
from dataprobe.operators.quantiles import median_row, quantile_row
from dataprobe.operators.selection import first_rows_of_groups
from dataprobe.operators.shape import columns_of
from dataprobe.scratch import materialise, spread

# fixed values: words that mark the positive class, and name parts that mark an identifier
POSITIVE_WORDS = ("yes", "1", "true", "churn", "positive", "cancelled", "risk", "high", "loss", "left")
ID_PARTS = ("id", "uuid", "code", "postal", "zip", "index", "unnamed", "row")


def is_id_like(name: str, parts: tuple[str, ...] = ID_PARTS) -> bool:
    """Whether a part of the name (between signs, digits or capitals) is one of ``parts``, or ends in ``id`` or ``uuid``
    written together with a word that names a thing, as in ``customerid``.

    Looking for the letters anywhere would take ``width``, ``paid_amount`` and ``incident_type`` for identifiers.
    """
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    return any(w in parts for w in words) or bool("id" in parts and re.search(r"(key|customer|client|user|order|product|item|account|patient|employee|student|record|session|transaction|store)id$", name.lower()))


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


# ---------------------------------------------------------------- categories

MAX_CLASSES = 10_000

def category_levels(df: DataFrame, columns: list[str], max_levels: int = 50, fill: str | None = None) -> dict[str, list[str]]:
    """Sorted values of each column that has at most ``max_levels`` of them.

    At most ``max_levels + 1`` values per column reach the driver.
    """
    if not columns:
        return {}
    text = df.select(*[_text(c, fill).alias(c) for c in columns])
    values = value_counts_by_column(text, columns)
    first = ranked_within(values, ["column"], [F.col("value")], max_levels + 1).select("column", "value")
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for r in first.collect():
        levels[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in levels.items() if len(v) <= max_levels}


def class_levels(df: DataFrame, column: str, max_classes: int = MAX_CLASSES) -> list[str]:
    """Sorted classes of a target; more than ``max_classes`` are an error, since a model holds a table per class.

    At most ``max_classes + 1`` values reach the driver.
    """
    value = F.col(column).cast("string").alias("v")
    levels = [r["v"] for r in df.select(value).na.drop().distinct().orderBy("v").limit(max_classes + 1).collect()]
    if len(levels) > max_classes:
        raise ValueError(f"{column} has more than {max_classes} classes: it is text, not a class")
    return levels


def class_codes(column: str, levels: list[str]) -> Column:
    """The class as a number, with its levels as metadata: without them a learner takes at most 100 classes."""
    return code_expr(column, levels).cast("double").alias("label", metadata={"ml_attr": {"type": "nominal", "vals": levels}})


def _text(c: str, fill: str | None) -> Column:
    t = F.col(c).cast("string")
    return t if fill is None else F.coalesce(t, F.lit(fill))


def code_expr(column: str, levels: list[str], fill: str | None = None) -> Column:
    """Position of the value among the sorted levels, from 0."""
    return (F.array_position(F.lit(levels), _text(column, fill)) - 1).cast("int")


def category_codes(df: DataFrame, columns: list[str], max_levels: int = 50, suffix: str = "") -> DataFrame:
    """Replace (or add, with a suffix) alphabetical ordinal codes."""
    levels = category_levels(df, columns, max_levels)
    return df.withColumns({c + suffix: code_expr(c, levels[c]) for c in columns if c in levels})


# -------------------------------------------------------------------- labels

@dataclass(frozen=True)
class Label:
    """A 0/1 label column, where it came from and what 1 stands for."""

    expr: Column
    source: str
    description: str


def few_values(df: DataFrame, column: str, limit: int) -> list | None:
    """The distinct known values when there are at most ``limit``, else null.

    A sketch rules out continuous columns first, so their distinct values are never shuffled.
    """
    if df.agg(F.approx_count_distinct(column)).first()[0] > 4 * limit + 20:
        return None
    rows = df.select(column).na.drop().distinct().limit(limit + 1).collect()
    return [r[0] for r in rows] if len(rows) <= limit else None


def binary_label(df: DataFrame, column: str, class_limit: int = 5, min_losses: int = 20) -> Label:
    """Derive a risk label from a class column or from a continuous one."""
    title = title_text(column)
    numeric = is_numeric(df, column)
    few = few_values(df, column, class_limit) if numeric else None
    if not numeric or few is not None:
        if numeric and {float(v) for v in few} <= {0.0, 1.0}:
            return Label(F.col(column).cast("int"), column, title)
        counts = value_counts_by_column(df.select(column), [column])
        lowered = F.lower("value")
        pattern = "|".join(POSITIVE_WORDS)
        match = counts.filter(lowered.rlike(pattern)).agg(F.min(lowered)).first()[0]
        if match is not None:
            return Label((F.lower(F.col(column).cast("string")) == match).cast("int"), column, f"{title} = {match}")
        rare = counts.orderBy("count", F.col("value").desc()).first()["value"]
        return Label((F.col(column).cast("string") == rare).cast("int"), column, f"{title} = {rare}")
    v = as_double(column)
    losses = df.agg(F.count_if(v < 0)).first()[0]
    if losses >= min_losses:
        return Label(F.coalesce(v <= 0, F.lit(False)).cast("int"), column, f"Unprofitable / Loss Risk ({title} <= 0)")
    cut = quantile_row(df, [column], [0.25]).first()[0][0]
    return Label(F.coalesce(v <= F.lit(cut), F.lit(False)).cast("int"), column, f"Low {title} Risk")


def has_variation(df: DataFrame, label: str = "label") -> bool:
    """Two classes or more, each with at least two rows."""
    r = df.groupBy(label).count().agg(F.count(F.lit(1)).alias("k"), F.min("count").alias("least")).first()
    return r["k"] >= 2 and r["least"] >= 2


def is_classification(df: DataFrame, target: str) -> bool:
    """Non-numeric, boolean, or at most ten distinct values."""
    if not is_numeric(df, target):
        return True
    return few_values(df, target, 10) is not None


# ------------------------------------------------------------------ features

def correlation_with(df: DataFrame, target: Column, features: list[str]) -> DataFrame:
    """``feature, correlation`` of each numeric feature with the target; rows are spread per feature in the task."""
    if not features:
        return df.sparkSession.createDataFrame([], "feature string, correlation double")
    values = df.select(as_double(target).alias("_y"), *[as_double(c).alias(f"x{i}") for i, c in enumerate(features)])
    cells = [F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("x")) for i in range(len(features))]
    long = values.select("_y", F.explode(F.array(*cells)).alias("s")).select("_y", "s.*").filter("x IS NOT NULL AND _y IS NOT NULL")
    r = F.try_divide(F.covar_pop("x", "_y"), F.stddev_pop("x") * F.stddev_pop("_y"))
    return long.groupBy("i").agg(r.alias("correlation")).select(F.get(F.lit(features), F.col("i")).alias("feature"), "correlation")


def leakage_report(df: DataFrame, source: str, max_corr: float = 0.90) -> DataFrame:
    """One row per candidate feature with the reason it is dropped, or ``kept``."""
    cands = [c for c in df.columns if c != source]
    numeric = [c for c in cands if is_numeric(df, c)] if is_numeric(df, source) else []
    counts = distinct_counts(df, cands).withColumnRenamed("column", "feature")
    known = df.sparkSession.createDataFrame([(c, is_id_like(c)) for c in cands], "feature string, id_like boolean")
    rows = F.broadcast(df.agg(F.count(F.lit(1)).alias("_rows")))
    # one row per column on every side
    r = (
        counts.join(F.broadcast(known), "feature")
        .join(F.broadcast(correlation_with(df, F.col(source), numeric)), "feature", "left")
        .crossJoin(rows)
    )
    verdict = (
        F.when(F.col("id_like"), "identifier")
        .when(F.col("distinct_count") <= 1, "constant")
        .when(F.col("distinct_count") >= F.col("_rows"), "all distinct")
        .when(F.abs("correlation") > max_corr, "collinear")
        .otherwise("kept")
    )
    return r.select("feature", "distinct_count", "correlation", verdict.alias("verdict"))


def leakage_free(df: DataFrame, source: str, max_corr: float = 0.90) -> list[str]:
    kept = {r["feature"] for r in leakage_report(df, source, max_corr).filter("verdict = 'kept'").collect()}
    return [c for c in df.columns if c in kept]


def feature_frame(df: DataFrame, features: list[str], keep: list[str | Column], max_levels: int = 50) -> tuple[DataFrame, list[str]]:
    """Numerics with medians for missing values, strings as codes ('Unknown' for null); others are left out."""
    numeric = [c for c in features if is_numeric(df, c)]
    strings = [c for c in features if c in columns_of(df, "string")]
    levels = category_levels(df, strings, max_levels, fill="Unknown")
    used = [c for c in features if c in numeric or c in levels]
    med = median_row(df, numeric) if numeric else None
    base = df if med is None else df.crossJoin(F.broadcast(med.select(*[F.col(c).alias(f"_m_{c}") for c in numeric])))
    cols = []
    for c in used:
        if c in numeric:
            cols.append(F.coalesce(as_double(c), F.col(f"_m_{c}"), F.lit(0.0)).alias(f"x_{c}"))
        else:
            cols.append(code_expr(c, levels[c], "Unknown").cast("double").alias(f"x_{c}"))
    return base.select(*keep, *cols), used


def assemble(frame: DataFrame, used: list[str]) -> DataFrame:
    va = VectorAssembler(inputCols=[f"x_{c}" for c in used], outputCol="features")
    return va.transform(frame)


#: rows of one partition of a forest's input: a learner keeps a number per tree of each row, some 600 bytes for 100 trees
FOREST_ROWS = 250_000


def forest_rows(frame: DataFrame, used: list[str]) -> DataFrame:
    """The assembled rows to fit a forest on, in partitions that memory holds whatever the table's size."""
    return assemble(spread(frame, FOREST_ROWS), used)


def stratified_split(df: DataFrame, label: str, key: list[str], test_share: float = 0.25, seed: int = 42) -> DataFrame:
    """Add ``is_test``: exactly ``ceil(n * share)`` rows of each class, chosen by a seeded hash of the key.

    The hash and key at each class's cut are found by counting, so no row is moved, whatever share a class has.
    """
    hashed = df.withColumn("_h", F.xxhash64(*key, F.lit(seed)))
    cut = first_rows_of_groups(hashed, label, ["_h", *key], test_share)
    return cut.select(*df.columns, F.col("_first").alias("is_test"))


# -------------------------------------------------------------------- models

@dataclass
class Fitted:
    """A fitted forest with the rows it was tested on."""

    model: object
    features: list[str]
    scored: DataFrame

    def importances(self) -> DataFrame:
        """``feature, feature_label, importance, percentage`` of every feature."""
        spark = self.scored.sparkSession
        rows = [(f, title_text(f), float(i)) for f, i in zip(self.features, self.model.featureImportances.toArray())]
        df = spark.createDataFrame(rows, "feature string, feature_label string, importance double")
        return df.select(
            "feature", "feature_label", half_even(F.col("importance"), 4).alias("importance"),
            half_even(F.col("importance") * 100, 1).alias("percentage"),
        )


def _score(model, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows)
    if isinstance(model, forest.Forest):
        return scored
    if "probability" in scored.columns:
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "features")


def _cells(frame: DataFrame, used: list[str], trees: int, classes: int, seed: int) -> forest.Bins | None:
    """The intervals of the features if a forest can be grown from cells: of many rows that fall into few."""
    rows = frame.count()
    if rows < forest.ROWS:
        return None
    bins = forest.find_bins(frame, used, rows, _max_bins(), seed)
    return bins if forest.fits(bins, rows, trees, classes) else None


def _max_bins(levels: int = 50) -> int:
    return max(32, levels + 1)


def risk_model(
    df: DataFrame, target: str, key: list[str], *, trees: int = 100, depth: int = 6, seed: int = 42, test_share: float | None = None
) -> Fitted:
    """Random forest on a derived risk label, leakage removed, scored on a stratified hold-out."""
    # labels, leakage, levels and medians each read the rows; a column without a type is all null and cannot be written
    df = materialise(df.select(*[f.name for f in df.schema if not isinstance(f.dataType, T.NullType)]), "risk-input")
    label = binary_label(df, target)
    used_cols = leakage_free(df.drop(*key), label.source)
    if not used_cols:
        raise ValueError("no independent features remain")
    frame, used = feature_frame(df, used_cols, [*key, label.expr.alias("label")])
    frame = frame.filter(F.col("label").isNotNull())
    if test_share is None:
        test_share = 0.25 if frame.limit(40).count() >= 40 else 0.2
    rows = materialise(stratified_split(frame, "label", key, test_share, seed), "risk")
    if not has_variation(rows):
        raise ValueError("target has too little variation")
    rf = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, minInstancesPerNode=2,
        maxBins=_max_bins(), seed=seed,
    )
    train = rows.filter(~F.col("is_test"))
    bins = _cells(train, used, trees, 2, seed)
    if bins:
        model, _ = forest.fit(train, F.lit(False), bins, classes=2, trees=trees, depth=depth, seed=seed, least=2, both=False)
    else:
        model = rf.fit(forest_rows(rows, used).filter(~F.col("is_test")))
    return Fitted(model, used, _score(model, assemble(spread(rows), used).filter("is_test")))


def risk_contributions(fit: Fitted, top: int = 8) -> DataFrame:
    impact = ladder(F.col("percentage"), [(20, "High Risk"), (8, "Medium Risk")], "Low Influence")
    return fit.importances().orderBy(F.col("importance").desc(), "feature").limit(top).withColumn("impact", impact)


def driver_direction(df: DataFrame, target: Column, features: list[str]) -> DataFrame:
    """``feature, correlation, direction`` of each numeric feature against the target."""
    found = correlation_with(df, target, features)
    r = F.coalesce("correlation", F.lit(0.0))
    direction = (
        F.when(r > 0.05, "Positive (Higher values increase target)")
        .when(r < -0.05, "Negative (Higher values decrease target)")
        .otherwise("Non-linear Complex Influence")
    )
    return found.select("feature", "correlation", direction.alias("direction"))


def target_drivers(
    df: DataFrame, target: str, *, trees: int = 50, depth: int = 6, seed: int = 42, key: list[str] | None = None, test_share: float = 0.25
) -> tuple[DataFrame, DataFrame]:
    """Importance and direction of every numeric feature, with in-sample and held-out scores.

    The fit uses all rows, as an explanation of the whole table; the held-out score comes from a second
    fit without the test rows.
    """
    parts = ("id", "uuid", "code", "index", "unnamed")
    features = [c for c in columns_of(df, "numeric") if c != target and not is_id_like(c, parts)]
    if not features:
        raise ValueError("no numeric features")
    # the target's kind, medians, correlations and the fits each read the rows
    hashed = F.xxhash64(*(key or df.columns), F.lit(seed)).alias("_h")
    rows = materialise(df.filter(F.col(target).isNotNull()).select(target, *features, hashed), "drivers-input")
    classify = is_classification(rows, target)
    if classify:
        levels = class_levels(rows, target)
        y = class_codes(target, levels)
    else:
        y = F.coalesce(as_double(target), F.lit(0.0))
    frame, used = feature_frame(rows, features, [y if classify else y.alias("label"), "_h"])
    frame = materialise(frame, "drivers")
    maker, subset = (RandomForestClassifier, "sqrt") if classify else (RandomForestRegressor, "all")
    rf = maker(
        labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, maxBins=_max_bins(),
        featureSubsetStrategy=subset,
    )
    is_test = F.pmod("_h", F.lit(1000)) < int(test_share * 1000)
    classes = len(levels) if classify else 0
    bins = _cells(frame, used, trees, classes, seed)
    if bins:
        full, held = forest.fit(frame, is_test, bins, classes=classes, trees=trees, depth=depth, seed=seed)
    else:
        fitted = forest_rows(frame, used)
        full, held = rf.fit(fitted), rf.fit(fitted.filter(~is_test))
    vec = assemble(spread(frame), used)
    fit = Fitted(full, used, _score(full, vec))
    direction = driver_direction(rows, y, features)
    impact = ladder(F.col("importance"), [(0.2, "High"), (0.08, "Medium")], "Moderate")
    drivers = (
        fit.importances()
        .filter(F.col("importance") >= 0.01)
        .join(F.broadcast(direction), "feature", "left")
        .withColumn("correlation", half_even(F.coalesce("correlation", F.lit(0.0)), 2))
        .withColumn("impact", impact)
        .orderBy(F.col("importance").desc(), "feature")
    )
    def measure(scored):
        if classify:
            return scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("s"))
        return metrics.r2_score(scored).select(F.greatest(F.lit(0.0), F.col("r2")).alias("s"))
    name = "Accuracy" if classify else "R2"
    scores = measure(fit.scored).select(F.lit("in sample").alias("scope"), F.col("s").alias("score")).unionByName(
        measure(_score(held, vec.filter(is_test))).select(F.lit("held out").alias("scope"), F.col("s").alias("score"))
    ).select(F.lit(name).alias("score_name"), "scope", half_even(F.col("score"), 3).alias("score"))
    return drivers, scores
