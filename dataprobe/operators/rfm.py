"""Recency, frequency and value per entity; scores, tiers and clusters."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.numeric import half_even, to_number, whole_days_between
from dataprobe.operators.aggregates import distinct_counts
from dataprobe.operators.ordering import row_index, quantile_bin
from dataprobe.operators.roles import rfm_roles
from dataprobe.operators.shape import columns_of
from dataprobe.scratch import materialise

# fixed values: tier names, top quartile first
TIERS = {
    "customer": ("Champions", "Loyal Advocates", "At-Risk Accounts", "Hibernating"),
    "generic": (
        "Tier 1 (High Performance / Top Quartile)", "Tier 2 (Above Average / Upper Mid)", "Tier 3 (Moderate / Lower Mid)",
        "Tier 4 (Low / Opportunity Quartile)",
    ),
    "agriculture": (
        "Optimal Tier (High Range)", "Balanced Baseline Tier (Standard)", "Moderate Deficit Tier (Sub-Optimal)", "Critical Deficit Tier (Low Range)",
    ),
    "healthcare": ("High Care Priority (Intensive Tier)", "Elevated Monitoring Tier", "Moderate Risk Tier", "Low Risk / Stable Tier"),
}
ACTIONS = ("Reward and protect", "Grow and cross-sell", "Win back now", "Reactivate at low cost")
MISSING_DATE_DAYS = 30


def entity_column(df: DataFrame, least: int = 3, most: int = 1000) -> str | None:
    """The column of entities: by name, else the first text column with ``least`` to ``most`` different values.

    One aggregate of sketches leaves out columns that are clearly too large, so only short lists of values are shuffled
    for the exact counts. None if no column fits.
    """
    named = rfm_roles(df)["entity"]
    texts = columns_of(df, "string")
    if named or not texts:
        return named
    rough = df.agg(*[F.approx_count_distinct(f"`{c}`", 0.01).alias(f"c{i}") for i, c in enumerate(texts)]).first()
    near = [c for c, n in zip(texts, rough) if n <= 1.1 * most]  # ten standard errors
    if not near:
        return None
    counts = distinct_counts(df, near)
    fit = {r["column"] for r in counts.collect() if least <= r["distinct_count"] <= most}  # one row per column
    return next((c for c in near if c in fit), None)


def rfm_base(df: DataFrame, entity: str, date: str | None, value: str, min_share: float = 0.3) -> DataFrame:
    """``entity, recency, frequency, monetary``; the value is summed, or averaged when there are no usable dates.

    Rows of one entity are pre-aggregated in each task, so an entity with a large share of the rows is no
    hot spot.
    """
    cols = [F.col(entity).alias("entity"), to_number(value).alias("_v") if not _is_decimal(df, value) else F.coalesce(F.col(value), F.lit(0)).alias("_v")]
    if date is None:
        rows = df.select(*cols).withColumn("_ok", F.lit(False)).withColumn("_day", F.lit(None).cast("timestamp"))
        rows = rows.withColumn("_max", F.lit(None).cast("timestamp"))
    else:
        rows = df.select(*cols, F.col(date).alias("_day"))
        facts = rows.agg(F.max("_day").alias("_max"), (F.avg(F.col("_day").isNotNull().cast("int")) > min_share).alias("_ok"))
        rows = rows.crossJoin(F.broadcast(facts))
    days = F.coalesce(whole_days_between(F.col("_max"), F.col("_day")), F.lit(MISSING_DATE_DAYS))
    g = rows.filter(F.col("entity").isNotNull()).groupBy("entity").agg(
        F.min(F.when(F.col("_ok"), days)).alias("recency"), F.count(F.lit(1)).alias("frequency"),
        F.sum("_v").alias("_sum"), F.max("_ok").alias("has_dates"),
    )
    total = F.col("_sum").cast("double")
    return g.select(
        "entity", "recency", "frequency", F.when(F.col("has_dates"), total).otherwise(total / F.col("frequency")).alias("monetary"), "has_dates"
    )


def _is_decimal(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() == "decimal"


def rfm_scores(base: DataFrame) -> DataFrame:
    """Quantile scores by rank (ties by entity): recency 0..q-1, frequency and value 1..q, and the mix.

    The monetary quartile used for the tiers is kept as ``quartile``.
    """
    base = materialise(base, "rfm")  # ranked three times
    n = base.count()
    q = min(4, max(2, n))
    out = base
    for name in ("recency", "frequency", "monetary"):
        out = row_index(out, [F.col(name).asc_nulls_last(), F.col("entity").asc()], f"_p_{name}")
    bin_ = lambda c, k: quantile_bin(F.col(f"_p_{c}"), F.lit(n), k)
    out = out.select(
        "entity", "recency", "frequency", "monetary", "has_dates",
        (F.lit(q - 1) - bin_("recency", q)).alias("r_score"), (bin_("frequency", q) + 1).alias("f_score"),
        (bin_("monetary", q) + 1).alias("m_score"), bin_("monetary", 4).alias("quartile"),
    )
    mix = F.col("r_score") * 0.3 + F.col("f_score") * 0.3 + F.col("m_score") * 0.4
    return out.withColumn("rfm_score", half_even(F.when(F.col("has_dates"), mix).otherwise(F.col("m_score").cast("double")), 2))


def strategies(spark, domain: str = "customer") -> DataFrame:
    """``quartile, segment, action, place``; four rows."""
    rows = [(3 - i, s, a, i + 1) for i, (s, a) in enumerate(zip(TIERS[domain], ACTIONS))]
    return spark.createDataFrame(rows, "quartile int, segment string, action string, place int")


def with_segments(scores: DataFrame, domain: str = "customer") -> DataFrame:
    return scores.join(F.broadcast(strategies(scores.sparkSession, domain)), "quartile", "left")


def rfm_segments(scores: DataFrame, domain: str = "customer") -> DataFrame:
    """One row per tier with count, share and means; empty tiers are kept with 0."""
    g = scores.groupBy("quartile").agg(
        F.count(F.lit(1)).alias("n"), F.avg("recency").alias("r"), F.avg("monetary").alias("m")
    )
    total = F.broadcast(scores.agg(F.count(F.lit(1)).alias("total")))
    rows = F.broadcast(strategies(scores.sparkSession, domain)).join(g, "quartile", "left").crossJoin(total)
    zero = lambda c, d: half_even(F.coalesce(c, F.lit(0.0)), d)
    return rows.select(
        "segment", F.coalesce("n", F.lit(0)).alias("entities"),
        half_even(F.coalesce("n", F.lit(0)) / F.greatest(F.col("total"), F.lit(1)) * 100, 1).alias("percentage"),
        zero(F.col("r"), 1).alias("avg_recency_days"), zero(F.col("m"), 2).alias("avg_monetary"), "action", "place",
    )


def rfm_top(scores: DataFrame, k: int = 8, domain: str = "customer") -> DataFrame:
    top = scores.orderBy(F.col("monetary").desc_nulls_last(), F.col("entity").asc()).limit(k)
    return with_segments(top, domain).select(
        "entity", "segment", "frequency", half_even(F.col("monetary"), 2).alias("total_value"), F.col("recency").cast("double").alias("recency_days")
    )


def rfm_retention(scores: DataFrame) -> DataFrame:
    """Share of the entities in the two upper tiers."""
    return scores.agg(
        F.count(F.lit(1)).alias("entities"),
        half_even(F.coalesce(F.avg(F.col("quartile").isin(2, 3).cast("double")), F.lit(0.0)) * 100, 1).alias("retention_rate"),
    )


# fixed values: cluster names in the order they are given out
CLUSTER_NAMES = ("Champions", "Loyal Customers", "At Risk", "Potential Loyalists")


def rfm_kmeans(base: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """``entity, cluster, segment``: K-Means on standardised values.

    The cluster with the highest value holds the Champions, the next the Loyal Customers; of the rest the
    one with the longer recency is At Risk.
    """
    rows = materialise(base.na.fill({"recency": MISSING_DATE_DAYS}), "rfm-kmeans")
    if rows.limit(10).count() < 10:
        raise ValueError("clusters need at least ten entities")
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=["recency", "frequency", "monetary"], outputCol="_raw"),
        StandardScaler(withMean=True, inputCol="_raw", outputCol="features"),
        KMeans(k=k, seed=seed, predictionCol="cluster"),
    ])
    out = pipe.fit(rows).transform(rows).drop("_raw", "features")
    return _named(out)


def _named(out: DataFrame) -> DataFrame:
    """Add ``segment``, the name of each row's cluster."""
    # k rows
    means = out.groupBy("cluster").agg(F.avg("monetary").alias("m"), F.avg("recency").alias("r")).collect()
    by_value = sorted(means, key=lambda c: (-c["m"], c["cluster"]))
    rest = sorted(by_value[2:], key=lambda c: (-c["r"], c["cluster"]))
    names = {c["cluster"]: CLUSTER_NAMES[min(i, 3)] for i, c in enumerate(by_value[:2] + rest)}
    label = F.lit(None).cast("string")
    for c, name in names.items():
        label = F.when(F.col("cluster") == c, name).otherwise(label)
    return out.withColumn("segment", label)


def rfm_clusters(base: DataFrame, k: int = 4, rounds: int = 20) -> DataFrame:
    """``base`` with ``cluster, segment``: K-Means without a seed, so that every run and engine gives the same clusters.

    Values are standardised. The first centre is the entity farthest from the mean, each next one the farthest from the
    centres so far (ties: the smallest entity); then at most ``rounds`` Lloyd rounds, each one grouped aggregate over a written
    table with the centres as literals. Ties go to the lower cluster, an empty cluster keeps its centre. Missing recency
    counts as in ``rfm_kmeans``, rows without frequency or value are left out; fewer different entities than ``k`` give
    fewer clusters. Names are given as in ``rfm_kmeans``.
    """
    names = ["recency", "frequency", "monetary"]
    rows = base.na.fill({"recency": MISSING_DATE_DAYS}).na.drop(subset=names)
    stats = rows.agg(*[f(c) for c in names for f in (F.avg, F.stddev_samp)]).first()
    scaled = [(F.col(c).cast("double") - F.lit(stats[2 * i])) / F.lit(stats[2 * i + 1] or 1.0) for i, c in enumerate(names)]
    axes = ["_x", "_y", "_z"]
    rows = materialise(rows.withColumns(dict(zip(axes, scaled))), "clusters")

    def apart(centre):
        return sum(((F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip(axes, centre)), F.lit(0.0))

    def nearest(centres):
        if len(centres) == 1:
            return F.lit(0)
        least = F.least(*map(apart, centres))
        label = F.lit(len(centres) - 1)
        for j in reversed(range(len(centres) - 1)):
            label = F.when(apart(centres[j]) == least, j).otherwise(label)
        return label

    centres: list[tuple[float, ...]] = []
    while len(centres) < k:
        far = F.least(*map(apart, centres)) if len(centres) > 1 else apart(centres[0] if centres else (0.0, 0.0, 0.0))
        seed = rows.select(*axes, "entity", far.alias("_d")).orderBy(F.desc("_d"), "entity").first()
        if seed is None or (centres and seed["_d"] == 0):
            break
        centres.append(tuple(seed[c] for c in axes))
    for _ in range(rounds if centres else 0):
        found = {r["cluster"]: tuple(r[c] for c in axes) for r in rows.groupBy(nearest(centres).alias("cluster")).agg(*[F.avg(c).alias(c) for c in axes]).collect()}
        new = [found.get(j, c) for j, c in enumerate(centres)]
        if new == centres:
            break
        centres = new
    return _named(rows.withColumn("cluster", nearest(centres or [(0.0, 0.0, 0.0)])).drop(*axes))
