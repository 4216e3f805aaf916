"""Order-dependent work over raw rows in range splits: Holt smoothing and trailing frames without one task.

Rows are range-split on the whole key, so neither a long table nor a hot series key ends in one task. What a split has to
know of the others is a few numbers or rows: an affine map for smoothing, the rows just before it for frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dataprobe.operators.ordering import range_split
from dataprobe.operators.timeseries import ALPHA, BETA

#: values that the starting trend looks at
START = 5


def _step(alpha: float, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """One smoothing step as a map of (level, trend): ``matrix @ state + value * vector``."""
    return np.array([[1 - alpha, 1 - alpha], [-alpha * beta, 1 - alpha * beta]]), np.array([alpha, alpha * beta])


def holt_scan(df: DataFrame, value: str, order_by: list[str], *, keys: list[str] | None = None, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """``keys..., level, trend, points``: the end of double exponential smoothing over raw rows in key order.

    Equal to folding step by step. A step is an affine map of (level, trend) and maps compose, so each split becomes one
    matrix and one vector per series, read in a stream; those of a series, one per split, are applied in order to
    its start, the first value and the mean of its first four differences. ``order_by`` ends in a unique key; rows
    without a value are left out, null keys are a series. An empty table gives no rows.
    """
    keys = keys or []
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.filter(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order_by)], F.col(value).cast("double").alias("_v"))
    order = [F.col(n).asc_nulls_first() for n in names] + [F.col(f"_o{i}").asc_nulls_last() for i in range(len(order_by))]
    # one null-safe group key, so that a change of series is one comparison
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct(F.spark_partition_id().alias("_split"), *names).alias("_g"), "_v")
    matrix, vector = _step(alpha, beta)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers: list[np.ndarray] = [np.eye(2)]
        weights = np.zeros((0, 2))
        now, n, c, first, typ = None, 0, np.zeros(2), [], None
        for b in batches:
            group, v, typ = b.column(0), b.column(1).to_numpy(), b.schema.field(0).type
            while len(powers) <= len(v):
                powers.append(matrix @ powers[-1])
            if len(weights) < len(v):
                weights = np.array([p @ vector for p in powers[: len(v)]])
            same = np.ones(max(len(v) - 1, 0), bool)
            for x in group.flatten():
                y = x.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                same &= y[1:] == y[:-1]
            edges = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(v)]]) if len(v) else []
            for lo, hi in zip(edges, edges[1:]):
                key = group[int(lo)].as_py()
                if key != now:
                    if now is not None:
                        yield _product(typ, now, n, c, first)
                    now, n, c, first = key, 0, np.zeros(2), []
                part = v[lo:hi]
                c = powers[len(part)] @ c + part[::-1] @ weights[: len(part)]
                first += part[: START - len(first)].tolist()
                n += len(part)
        if now is not None:
            yield _product(typ, now, n, c, first)

    def _product(typ, key, n, c, first) -> pa.RecordBatch:
        m = np.linalg.matrix_power(matrix, n)
        values = [pa.array([key], typ), pa.array([n]), pa.array([[*m.ravel(), *c]], pa.list_(pa.float64())), pa.array([first], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(values, ["_g", "n", "map", "first"])

    group_type = rows.schema["_g"].dataType
    products = rows.mapInArrow(scan, f"_g {group_type.simpleString()}, n long, map array<double>, first array<double>")
    series = products.groupBy(*[F.col(f"_g.{n}").alias(n) for n in names]).agg(F.array_sort(F.collect_list(F.struct(F.col("_g._split").alias("split"), "n", "map", "first"))).alias("p"))
    start = F.slice(F.flatten(F.transform("p", lambda s: s["first"])), 1, START)
    series = series.select(*names, "p", start.alias("s"))
    slope = F.coalesce(F.try_divide(F.element_at("s", -1) - F.element_at("s", 1), (F.size("s") - 1).cast("double")), F.lit(0.0))
    begin = F.struct(F.element_at("s", 1).alias("l"), slope.alias("t"))

    def apply(state: Column, s: Column) -> Column:
        m = s["map"]
        return F.struct((m[0] * state["l"] + m[1] * state["t"] + m[4]).alias("l"), (m[2] * state["l"] + m[3] * state["t"] + m[5]).alias("t"))

    end = series.select(*names, F.aggregate("p", begin, apply).alias("e"), F.aggregate("p", F.lit(0).cast("long"), lambda a, s: a + s["n"]).alias("points"))
    return end.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("e.l").alias("level"), F.col("e.t").alias("trend"), "points")


def with_trailing(df: DataFrame, order_by: list[Column | str], rows: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """``df`` with ``columns`` over a frame that reaches ``rows`` - 1 rows back in the order of the whole table.

    ``columns`` gets a window ordered like the table, to which it adds its frame, as in ``w.rowsBetween(-6, 0)``; it may look back
    ``rows`` - 1 rows at most. Every split also gets the rows just before it, from as many splits as these lie in, and
    computes its own frames. ``order_by`` ends in a unique key.
    """
    split = range_split(df, order_by)
    # one row per split
    sizes = sorted((r["_split"], r["n"]) for r in split.groupBy("_split").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for s, n in sizes:
        starts.append((s, total, total + n))
        total += n
    begin = df.sparkSession.createDataFrame(starts, "_split long, _from long, _to long")
    placed = split.join(F.broadcast(begin), "_split").withColumn("_at", F.col("_from") + F.col("_pos"))
    if rows > 1 and len(starts) > 1:
        all_ = df.sparkSession.createDataFrame([([(s, a) for s, a, _ in starts],)], "_later array<struct<s: long, a: long>>")  # one row
        tail = placed.filter(F.col("_at") + rows - 1 >= F.col("_to")).crossJoin(F.broadcast(all_))
        needed = F.filter("_later", lambda x: (x["a"] > F.col("_at")) & (x["a"] <= F.col("_at") + rows - 1))
        halo = tail.withColumn("_split", F.explode(F.transform(needed, lambda x: x["s"]))).drop("_later").withColumn("_own", F.lit(False))
        placed = placed.withColumn("_own", F.lit(True)).unionByName(halo)
    else:
        placed = placed.withColumn("_own", F.lit(True))
    window = Window.partitionBy("_split").orderBy("_at")
    names = columns(window)
    return placed.withColumns(names).filter("_own").select(*[f"`{c}`" for c in df.columns if c not in names], *names)
