"""Column profiles: semantic type, counts, range and sample values of every column.

Two passes over the table whatever its width: one aggregate for counts and ranges, one grouping of
(column, value) for distinct counts and samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.functions.numeric import is_missing
from dataprobe.operators.aggregates import value_counts_by_column
from dataprobe.operators.ordering import ranked_within
from dataprobe.operators.shape import TEMPORAL, parse_timestamp, safe_names

# fixed values
BOOLEAN_TEXT = ("0", "1", "true", "false", "True", "False")
ID_NAMES = ("id", "code", "uuid")
NUMERIC_TARGETS = ("revenue", "profit", "sales", "churn", "target", "score", "amount", "cost")
BOOLEAN_TARGETS = ("churn", "cancelled", "fraud", "converted")
CATEGORY_LIMIT = 60
CATEGORY_SHARE = 0.10
DATE_SHARE = 0.8
SAMPLES = 5
_DATE_LIKE = r"^\s*\d{1,4}[-/]\d{1,2}[-/]\d{1,4}"


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, TEMPORAL):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.NumericType):
        return "float"
    return "string" if isinstance(dtype, T.StringType) else "other"


def looks_like_date(c: Column) -> Column:
    """The cheap pattern keeps the parsers away from ordinary text."""
    return F.when(c.rlike(_DATE_LIKE), parse_timestamp(c).isNotNull()).otherwise(False)


def two_decimals(c: Column) -> Column:
    """Rounded to cents, at least one decimal: 900.0, 12.34."""
    return F.regexp_replace(F.round(c.cast("double"), 2).cast("decimal(38,2)").cast("string"), "0$", "")


def _measures(v: Column, fam: str) -> list[Column]:
    """Counts and range of the values of one family."""
    zero = F.lit(0).cast("long")
    if fam == "number":
        known = F.when(~F.isnan(v), v)
        parts = [F.count_if(~known.isin(0, 1)), F.count_if(known % 1 != 0), zero, two_decimals(F.min(known)), two_decimals(F.max(known))]
    elif fam == "string":
        known = v
        parts = [F.count_if(~v.isin(*BOOLEAN_TEXT)), zero, F.count_if(looks_like_date(v)), F.min(v), F.max(v)]
    else:
        known = v
        text = lambda t: F.date_format(t.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        ends = [text(F.min(v)), text(F.max(v))] if fam == "datetime" else [F.lit(None).cast("string")] * 2
        parts = [zero, zero, zero, *ends]
    names = ("not_boolean", "fractions", "dates", "lo", "hi")
    return [F.count(F.lit(1)).alias("rows"), F.count_if(known.isNull()).alias("missing_count"), *[p.alias(n) for p, n in zip(parts, names)]]


def _measure(flat: DataFrame, keys: list[str], fam: str) -> DataFrame:
    """Counts and range per column of one family. Texts are not stacked: grouped least and greatest texts would be sorted first."""
    if fam == "string":
        row = flat.agg(*[F.struct(F.lit(k).alias("key"), *_measures(F.col(k), fam)).alias(k) for k in keys])
        return row.select(F.explode(F.array(*keys)).alias("s")).select("s.*")
    return flat.unpivot([], keys, "key", "v").groupBy("key").agg(*_measures(F.col("v"), fam))


# how each family is measured, and as what type
_MEASURED = {
    "integer": ("number", "double"), "float": ("number", "double"), "string": ("string", "string"),
    "datetime": ("datetime", "timestamp_ntz"), "boolean": ("other", "boolean"), "other": ("other", None),
}


def column_facts(df: DataFrame) -> DataFrame:
    """One row per column: position, schema family and measurements.

    Columns of one family are stacked and grouped by column, texts are one wide aggregate: each is read once, a task
    shuffles one record per column and keeps no rows.
    """
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    families = [_family(f.dataType) for f in df.schema]
    safe = safe_names(df.columns)
    known = df.sparkSession.createDataFrame(
        [(f"c{i}", i, f.name, safe[i], families[i]) for i, f in enumerate(df.schema)],
        "key string, position int, column_name string, safe_column_name string, family string",
    )
    facts = None
    for fam in ("number", "string", "datetime", "other"):
        at = [i for i, f in enumerate(families) if _MEASURED[f][0] == fam]
        if not at:
            continue
        # of a nested column only the gaps are measured
        value = lambda i: F.col(f"c{i}").cast(_MEASURED[families[i]][1]) if families[i] != "other" else F.when(F.col(f"c{i}").isNotNull(), True)
        part = _measure(flat.select(*[value(i).alias(f"c{i}") for i in at]), [f"c{i}" for i in at], fam)
        facts = part if facts is None else facts.unionByName(part)
    return known.join(F.broadcast(facts), "key", "left").na.fill(0, ["rows", "missing_count", "not_boolean", "fractions", "dates"])


def _value_facts(df: DataFrame, exact: bool) -> DataFrame:
    """``key, distinct_count, sample_values``.

    Exact: distinct values are grouped and counted, samples are the first in order. Otherwise mergeable
    sketches of fixed size in one pass: nothing but the sketches is shuffled, samples are frequent values.
    """
    keys = [f"c{i}" for i in range(len(df.columns))]
    flat = df.toDF(*keys)
    clean = flat.select(*[F.when(~is_missing(f.name, f.dataType), F.col(f.name)).alias(f.name) for f in flat.schema])
    if not exact:
        tall = clean.select(*[F.col(k).cast("string").alias(k) for k in keys]).unpivot([], keys, "key", "v")
        frequent = F.expr(f"transform(approx_top_k(v, {SAMPLES}), x -> x.item)")
        return tall.groupBy("key").agg(
            F.approx_count_distinct("v", 0.01).alias("distinct_count"),
            F.array_sort(F.filter(frequent, lambda v: v.isNotNull())).alias("sample_values"),
        )
    values = value_counts_by_column(clean, keys)
    samples = (
        ranked_within(values, ["column"], [F.col("value")], SAMPLES)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    )
    counts = values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    return counts.join(samples, "column", "left").withColumnRenamed("column", "key")


def _has_any(name: Column, words) -> Column:
    return F.lower(name).rlike("|".join(words))


def semantic_type() -> Column:
    """The type rules, first hit wins, over the measured facts of a column."""
    known = F.col("rows") - F.col("missing_count")
    fam, distinct = F.col("family"), F.col("distinct_count")
    two_valued = (F.col("not_boolean") == 0) & (distinct <= 2)
    few = (distinct <= CATEGORY_LIMIT) | (distinct / F.greatest(F.col("rows"), F.lit(1)) < CATEGORY_SHARE)
    return (
        F.when(known == 0, "text")
        .when(fam == "datetime", "datetime")
        .when(fam == "boolean", "boolean")
        .when(fam.isin("integer", "string") & two_valued, "boolean")
        .when((fam == "integer") | ((fam == "float") & (F.col("fractions") == 0)), "integer")
        .when(fam == "float", "float")
        .when(fam == "other", "text")
        .when(F.col("dates") >= known * DATE_SHARE, "datetime")
        .when(_has_any(F.col("column_name"), ID_NAMES), "id")
        .when(few, "categorical")
        .otherwise("text")
    )


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column, in column order."""
    facts = column_facts(df).join(F.broadcast(_value_facts(df, exact)), "key", "left")
    facts = facts.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0).cast("long")))
    typed = facts.withColumn("detected_type", semantic_type())
    kind, name = F.col("detected_type"), F.col("column_name")
    numeric = kind.isin("integer", "float")
    ranged = numeric | (kind == "datetime")
    candidate = (numeric & _has_any(name, NUMERIC_TARGETS)) | ((kind == "boolean") & _has_any(name, BOOLEAN_TARGETS))
    return typed.select(
        "position", "column_name", "safe_column_name", "detected_type",
        (kind == "datetime").alias("is_date"), numeric.alias("is_numeric"), (kind == "categorical").alias("is_categorical"),
        candidate.alias("is_target_candidate"), "distinct_count", "missing_count", "rows",
        F.when(ranged, F.col("lo")).alias("min_value"), F.when(ranged, F.col("hi")).alias("max_value"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"), "family",
    ).orderBy("position")


# fixed values: target keywords, best first
TARGET_WORDS = (
    "revenue", "profit", "sales", "mrr_generated", "spend", "cost", "treatment_cost", "churn", "order_cancelled",
    "cancelled", "readmission_30d", "conversion", "converted", "roi", "cpa", "target", "score", "price", "amount",
    "output", "label", "outcome", "status", "crop", "disease", "heartdisease", "diagnosis", "class", "category",
)


def target_ranking(profiles: DataFrame) -> DataFrame:
    """Profile rows that may serve as target, best first, with the reason."""
    name = F.lower("column_name")
    whole = F.array_position(F.lit(list(TARGET_WORDS)), name)
    plain = ~name.rlike("id|uuid|code")
    parts = [F.when(plain & name.contains(w), F.lit(i + 1)) for i, w in enumerate(TARGET_WORDS)]
    rank = F.least(F.when(whole > 0, whole), *parts)
    place = (
        F.when(rank.isNotNull(), rank)
        .when(F.col("is_target_candidate"), F.lit(100))
        .when(F.col("is_numeric") & (F.col("distinct_count") > 5), F.lit(200))
    )
    reason = F.when(rank.isNotNull(), "keyword").when(F.col("is_target_candidate"), "candidate").otherwise("numeric")
    return (
        profiles.withColumn("_place", place.cast("int"))
        .filter(F.col("_place").isNotNull())
        .select("column_name", F.col("_place").alias("priority"), reason.alias("reason"), "position")
        .orderBy("priority", "position")
    )


def best_target(profiles: DataFrame) -> str | None:
    r = target_ranking(profiles).limit(1).collect()
    return r[0]["column_name"] if r else None
