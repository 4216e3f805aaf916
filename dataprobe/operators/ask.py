"""Answers to question intents: ranked breakdowns for a whole log at once, and their facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataprobe.functions.formatting import contains_any, format_short
from dataprobe.functions.numeric import half_even
from dataprobe.operators.aggregates import breakdown
from dataprobe.operators.intent import Catalogue
from dataprobe.operators.ordering import top_k

INTENT = ["dimension", "metric", "aggregation", "direction", "limit"]
# fixed values: name parts of money columns in answers
MONEY_PARTS = ("sales", "profit", "revenue", "price", "cost", "amount", "spend", "mrr", "arr", "value")


def answer_one(df: DataFrame, dimension: str, metric: str | None, aggregation: str, direction: str = "DESC", limit: int = 10) -> DataFrame:
    """``label, value, count`` of one question."""
    rows = breakdown(df, dimension, metric, aggregation)
    return top_k(rows, "value", "label", limit, ascending=direction == "ASC")


OVERALL = "All records"


def _cells(df: DataFrame, cat: Catalogue) -> DataFrame:
    """``dimension, metric, aggregation, label, value, count`` of every combination, in one aggregate.

    Without a dimension the only label is ``All records``; without a metric the value is the number of records.
    """
    dims, metrics = cat.categorical + cat.dates, cat.numeric
    rows = df.select(F.lit(OVERALL).alias("_all"), *[F.col(d).cast("string").alias(d) for d in dims], *[F.col(m).alias(f"_m_{m}") for m in metrics])
    long = rows.withColumn("_one", F.lit(1)).unpivot(["_one", *[f"_m_{m}" for m in metrics]], ["_all", *dims], "dimension", "label").filter(F.col("label").isNotNull())
    aggs = [F.count(F.lit(1)).alias("count")]
    for m in metrics:
        for name, f in (("sum", F.sum), ("avg", F.avg), ("max", F.max), ("min", F.min)):
            aggs.append(half_even(f(f"_m_{m}").cast("double"), 2).alias(f"{name}_{m}"))
    g = long.groupBy(F.nullif("dimension", F.lit("_all")).alias("dimension"), "label").agg(*aggs)

    def cell(metric: str | None, name: str, value: Column) -> Column:
        return F.struct(F.lit(metric).cast("string").alias("metric"), F.lit(name).alias("aggregation"), value.cast("double").alias("value"))

    cells = [cell(m, a, F.col(f"{a}_{m}")) for m in metrics for a in ("sum", "avg", "max", "min")]
    cells += [cell(m, "count", F.col("count")) for m in [*metrics, None]]
    return g.select("dimension", "label", "count", F.explode(F.array(*cells)).alias("s")).select("dimension", "label", "count", "s.*")


def answer_log(df: DataFrame, intents: DataFrame, cat: Catalogue) -> DataFrame:
    """One answer per distinct intent: ``dimension, metric, aggregation, direction, limit, rank, label, value, count, asked``.

    An intent without a dimension is answered with one row over all records, one without a metric with the number
    of records (its aggregation reads ``count``). Every combination is aggregated once; those asked for are ranked
    per direction, down to the largest limit asked for.
    """
    counted = F.when(F.col("metric").isNull(), F.lit("count")).otherwise(F.col("aggregation"))
    distinct = intents.filter(~F.col("off_topic")).withColumn("aggregation", counted).groupBy(*INTENT).agg(F.count(F.lit(1)).alias("asked"))
    wanted = distinct.groupBy("dimension", "metric", "aggregation", "direction").agg(F.max("limit").alias("_most"))
    cells = _cells(df, cat).withColumnsRenamed({"dimension": "_d", "metric": "_m", "aggregation": "_a"})
    here = F.col("dimension").eqNullSafe(F.col("_d")) & F.col("metric").eqNullSafe(F.col("_m")) & (F.col("aggregation") == F.col("_a"))
    asked = wanted.join(cells, here).drop("_d", "_m", "_a")
    up = F.when(F.col("direction") == "ASC", F.col("value")).otherwise(-F.col("value"))
    order = Window.partitionBy("dimension", "metric", "aggregation", "direction").orderBy(up.asc_nulls_last(), F.col("label"))
    ranked = asked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("_most")).drop("_most")
    r = ranked.withColumnsRenamed({c: f"_{c}" for c in INTENT[:4]})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in INTENT[:4]]
    joined = distinct.join(r, same[0] & same[1] & same[2] & same[3])
    return joined.filter(F.col("rank") <= F.col("limit")).select(*INTENT, "rank", "label", "value", "count", "asked")


def answer_facts(answers: DataFrame, dollar: bool = False) -> DataFrame:
    """Leader, last and number of groups of each answer, values as text."""
    first, last = lambda c: F.min_by(c, "rank"), lambda c: F.max_by(c, "rank")
    g = answers.groupBy(*INTENT).agg(
        first("label").alias("leader"), first("value").alias("_a"), last("label").alias("last"), last("value").alias("_b"),
        F.count(F.lit(1)).alias("groups"),
    )
    money = F.lit(dollar) & contains_any(F.lower(F.col("metric")), MONEY_PARTS)
    text = lambda c: format_short(F.col(c), money)
    return g.select(*INTENT, "leader", text("_a").alias("leader_value"), "last", text("_b").alias("last_value"), "groups")
