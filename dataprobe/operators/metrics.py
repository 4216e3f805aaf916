"""Evaluation of predictions as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.numeric import half_even, ratio
from dataprobe.operators.ordering import running_total


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``label, prediction, count``."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count")
    )


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", digits: int = 1) -> DataFrame:
    """Accuracy, precision, recall and F1 in percent; a metric that is undefined counts as 0."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp", "fp", "fn", "tn",
        _pct(ratio(tp + tn, tp + fp + fn + tn), digits).alias("accuracy"),
        _pct(ratio(tp, tp + fp), digits).alias("precision"),
        _pct(ratio(tp, tp + fn), digits).alias("recall"),
        _pct(ratio(2 * tp, 2 * tp + fp + fn), digits).alias("f1"),
    )


def _pct(c: Column, digits: int) -> Column:
    return half_even(F.coalesce(c, F.lit(0.0)) * 100, digits)


def weighted_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", digits: int = 1) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 over all classes, in percent."""
    m = confusion_matrix(df, label, prediction)
    actual = m.select(F.col("label").alias("c"), "count", (F.col("label") == F.col("prediction")).alias("hit"), F.lit(True).alias("is_label"))
    guessed = m.select(F.col("prediction").alias("c"), "count", F.lit(False).alias("hit"), F.lit(False).alias("is_label"))
    per = actual.unionByName(guessed).groupBy("c").agg(
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("count"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("is_label"), F.col("count"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~F.col("is_label"), F.col("count"))), F.lit(0)).alias("guessed"),
    )
    tp, support, guessed = (F.col(c) for c in ("tp", "support", "guessed"))
    zero = F.lit(0.0)
    parts = per.select(
        "tp", "support",
        F.coalesce(ratio(tp, guessed), zero).alias("precision"),
        F.coalesce(ratio(tp, support), zero).alias("recall"),
        F.coalesce(ratio(2 * tp, support + guessed), zero).alias("f1"),
    )
    w = lambda c: _pct(ratio(F.sum(F.col(c) * support), F.sum("support")), digits).alias(c)
    return parts.agg(_pct(ratio(F.sum("tp"), F.sum("support")), digits).alias("accuracy"), w("precision"), w("recall"), w("f1"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", digits: int = 3) -> DataFrame:
    """Area under the ROC curve by rank sums, ties averaged; null when one class is missing.

    Scores are grouped first, and the running count of negatives works on range splits.
    """
    y = F.col(label) == 1
    by_score = df.groupBy(F.col(score).alias("s")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    run = running_total(by_score, ["s"], ["neg"])
    wins = F.col("pos") * (F.col("upto_neg") - F.col("neg") / 2)
    return run.agg(half_even(ratio(F.sum(wins), F.sum("pos") * F.sum("neg")), digits).alias("roc_auc"))


def r2_score(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of explained variance; null when the label is constant."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return df.agg((1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))).alias("r2"))
