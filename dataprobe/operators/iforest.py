"""Isolation forest: trees grown from small hash-chosen subsamples, scored over partitions.

Each row decides by hash which trees may use it, so building the subsamples is one pass that emits a bounded
number of rows whatever the table's size. One group per tree then grows a tree of at most 511 nodes; all
trees together are small enough to ship to every task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataprobe.operators.quantiles import quantile_row
from dataprobe.scratch import materialise

TREES, SAMPLE, SEED = 100, 256, 42
_EULER = 0.5772156649015329
_BUCKETS = 1 << 62  # fine enough for any table size


def mean_path(n) -> np.ndarray:
    """Average path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + _EULER
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _known(c: str) -> Column:
    """A feature as the trees see it: missing values and NaN are 0, when grown as when scored."""
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def subsamples(df: DataFrame, features: list[str], key: list[str], rows: int, trees: int, sample: int, seed: int) -> DataFrame:
    """``tree`` and the features of at most ``sample`` rows per tree."""
    keep = min(1.0, 1.5 * sample / max(rows, 1) + 40 / max(rows, 1))
    place = lambda t: F.pmod(F.xxhash64(*key, t, F.lit(seed)), F.lit(_BUCKETS))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: place(t) < int(keep * _BUCKETS))
    picked = df.select(*key, *[_known(c).alias(f"x{i}") for i, c in enumerate(features)], F.explode(chosen).alias("tree"))
    order = Window.partitionBy("tree").orderBy(place(F.col("tree")), *key)
    ranked = picked.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= sample)
    return ranked.select("tree", *[f"x{i}" for i in range(len(features))])


def _grower(width: int, depth_limit: int, seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf[[f"x{i}" for i in range(width)]].to_numpy(float)
        x = x[np.lexsort(x.T[::-1])]  # the tree must not depend on arrival order
        rng = np.random.default_rng([seed, tree])
        nodes, work = [], [(0, np.arange(len(x)), 0)]
        while work:
            node, rows, depth = work.pop()
            lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
            open_ = np.flatnonzero(hi > lo)
            if depth >= depth_limit or len(rows) <= 1 or len(open_) == 0:
                nodes.append((tree, node, -1, 0.0, depth + float(mean_path(len(rows)))))
                continue
            f = int(rng.choice(open_))
            cut = float(rng.uniform(lo[f], hi[f]))
            left = x[rows, f] <= cut
            nodes.append((tree, node, f, cut, 0.0))
            work += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "path"])

    return grow


def fit(df: DataFrame, features: list[str], key: list[str], *, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> tuple[DataFrame, int]:
    """Tree nodes (at most ``trees * 2 * sample`` rows) and the subsample size."""
    rows = df.count()
    size = min(sample, rows)
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    picked = subsamples(df, features, key, rows, trees, sample, seed)
    schema = "tree int, node long, feature int, cut double, path double"
    return picked.groupBy("tree").applyInPandas(_grower(len(features), depth, seed), schema), size


def score(df: DataFrame, features: list[str], nodes: DataFrame, size: int) -> DataFrame:
    """Add ``score`` in 0..1, higher is more isolated."""
    forest = {t: g.set_index("node") for t, g in nodes.toPandas().groupby("tree")}
    packed = {t: (g.index.to_numpy(), g["feature"].to_numpy(), g["cut"].to_numpy(), g["path"].to_numpy()) for t, g in forest.items()}
    shared = df.sparkSession.sparkContext.broadcast(packed)
    norm = float(mean_path(size)) or 1.0
    names = list(features)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = []
        for ids, feature, cut, path in shared.value.values():
            order = np.argsort(ids)
            trees.append((ids[order], feature[order], cut[order], path[order]))
        for pdf in batches:
            x = pdf[names].astype(float).fillna(0).to_numpy()
            total = np.zeros(len(x))
            for ids, feature, cut, path in trees:
                at = np.zeros(len(x), dtype=np.int64)
                spot = np.searchsorted(ids, at)
                while True:
                    inner = feature[spot] >= 0
                    if not inner.any():
                        break
                    rows = np.flatnonzero(inner)
                    s = spot[rows]
                    left = x[rows, feature[s]] <= cut[s]
                    at[rows] = 2 * at[rows] + np.where(left, 1, 2)
                    spot = np.searchsorted(ids, at)
                total += path[spot]
            pdf["score"] = np.power(2.0, -(total / max(len(trees), 1)) / norm)
            yield pdf

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", score double"
    return df.mapInPandas(walk, schema)


def isolate(df: DataFrame, features: list[str], key: list[str], contamination: float = 0.04, **kw) -> DataFrame:
    """Add ``score`` and ``is_isolated``: scores above the (1 - contamination) quantile."""
    df = materialise(df, "isolate-in")
    nodes, size = fit(df, features, key, **kw)
    scored = materialise(score(df, features, nodes, size), "isolate-out")
    cut = quantile_row(scored, ["score"], [1 - contamination]).select(F.col("score")[0].alias("_cut"))
    return scored.crossJoin(F.broadcast(cut)).withColumn("is_isolated", F.col("score") > F.col("_cut")).drop("_cut")
