"""The best single cut of every feature: a repeatable companion to the forests' importances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataprobe.operators.ordering import running_total
from dataprobe.scratch import materialise


def split_gains(df: DataFrame, target: Column, features: list[str], digits: int = 9) -> DataFrame:
    """``feature, threshold, gain, n_below, mean_below, mean_above``: rows at or below the threshold against those above.

    ``gain`` is the share of the target's variance that the cut explains, rounded to ``digits``; for a target of 0 and 1 that
    is the share of its Gini impurity. Every cut between two values is tried; ties go to the smaller threshold. Rows are
    summed up to one per (feature, value) before they are sorted in range splits, so neither a feature of many values nor a
    hot value lands in one task. Rows with a null or NaN target count nowhere, those with such a feature not for it. A
    feature without two values, or a target without variance, gives no row.
    """
    values = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in features])
    tall = df.select(target.cast("double").alias("y"), values.alias("f")).filter(F.col("y").isNotNull() & ~F.isnan("y"))
    # around the mean, so that the squares lose no digits
    mean = tall.agg(F.avg("y")).first()[0] or 0.0
    y = F.col("y") - F.lit(mean)
    tall = tall.select(y.alias("y"), F.explode("f").alias("f")).select("y", "f.*").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    grouped = materialise(tall.groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")), "gains")
    sums = running_total(grouped, ["feature", "value"], ["n", "s"])
    # one row per feature; what earlier features add to the running sums is taken off again
    earlier = Window.orderBy("feature").rowsBetween(Window.unboundedPreceding, -1)
    whole = grouped.groupBy("feature").agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"), F.sum("q").alias("q_all"))
    whole = whole.withColumns({"n_off": F.coalesce(F.sum("n_all").over(earlier), F.lit(0)), "s_off": F.coalesce(F.sum("s_all").over(earlier), F.lit(0.0))})
    cuts = sums.join(F.broadcast(whole), "feature").select("feature", "value", (F.col("upto_n") - F.col("n_off")).alias("nl"), (F.col("upto_s") - F.col("s_off")).alias("sl"), "n_all", "s_all", "q_all")
    cuts = cuts.withColumns({"nr": F.col("n_all") - F.col("nl"), "sr": F.col("s_all") - F.col("sl")}).filter("nr > 0")
    none = F.col("s_all") * F.col("s_all") / F.col("n_all")
    spread = F.col("q_all") - none
    gain = F.when(spread > 0, (F.col("sl") * F.col("sl") / F.col("nl") + F.col("sr") * F.col("sr") / F.col("nr") - none) / spread)
    best = cuts.withColumn("gain", F.round(gain, digits)).filter("gain is not null").groupBy("feature").agg(
        F.max(F.struct("gain", (-F.col("value")).alias("_v"), F.col("nl").alias("n"), (F.col("sl") / F.col("nl")).alias("lo"), (F.col("sr") / F.col("nr")).alias("hi"))).alias("b")
    )
    return best.select("feature", (-F.col("b._v")).alias("threshold"), "b.gain", F.col("b.n").alias("n_below"), (F.col("b.lo") + mean).alias("mean_below"), (F.col("b.hi") + mean).alias("mean_above"))
