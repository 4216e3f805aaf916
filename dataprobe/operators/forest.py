"""Random forests over very many rows that fall into few cells.

A forest looks at a feature through at most ``bins`` intervals. Rows with the same intervals in all features form a cell;
for a tree they are the same but for their label and how often the bootstrap draws them. So one pass over the rows sums up
each cell, and each tree is then grown from the cells alone, in one task. Nothing is left out: every row is drawn
Poisson(1) times for each tree, as in MLlib, whose splits, impurities, subsets of features, votes and importances
these trees have as well; only the random numbers differ. A class needs its number of rows in a cell (the draws of n rows
are Poisson(n)), a number the sums of its draws, made row by row.

``fits`` says whether the rows fall into few cells whatever their values: the product of the intervals bounds their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.scratch import materialise

#: rows from which on cells are used, cells at most and sums that a task holds at most
ROWS, CELLS, SUMS = 2_000_000, 1 << 21, 1 << 22
#: rows whose draws are made at once
DRAWN = 32_768


@dataclass
class Bins:
    """The upper ends of the intervals of each feature but the last, which has none."""

    features: list[str]
    ends: list[np.ndarray]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(e) + 1 for e in self.ends)

    @property
    def cells(self) -> int:
        return math.prod(self.shape)

    def cell(self, batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        """The cell of each row."""
        out = np.zeros(batch.num_rows, np.int64)
        for c, e in zip(self.features, self.ends):
            x = batch[f"x_{c}"].to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[f"x_{c}"].to_numpy()
            out = out * (len(e) + 1) + np.searchsorted(e, x)
        return out

    def places(self, cells: np.ndarray) -> np.ndarray:
        """The interval of each feature, by cell and feature."""
        return np.stack(np.unravel_index(cells, self.shape), axis=1) if len(cells) else np.zeros((0, len(self.ends)), np.int64)


def find_bins(frame: DataFrame, features: list[str], rows: int, bins: int, seed: int) -> Bins:
    """Intervals as MLlib finds them: between all values of some 10,000 rows, or at their quantiles if these are many."""
    share = min(1.0, max(bins * bins, 10_000) / max(rows, 1))
    sample = frame.select(*[f"x_{c}" for c in features]).sample(share, seed).toArrow()
    return Bins(features, [_ends(sample[f"x_{c}"].to_numpy(), bins) for c in features])


def _ends(x: np.ndarray, bins: int) -> np.ndarray:
    values, counts = np.unique(x[~np.isnan(x)], return_counts=True)
    middle = (values[1:] + values[:-1]) / 2
    if len(middle) <= bins - 1:
        return middle
    upto, step, out, target = np.cumsum(counts), counts.sum() / bins, [], counts.sum() / bins
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += step
    return np.array(out[: bins - 1])


def fits(bins: Bins, rows: int, trees: int, classes: int) -> bool:
    """Whether the cells are few beside the rows and their sums fit a task."""
    sums = bins.cells * classes if classes else bins.cells * trees * 3
    return bins.cells <= CELLS and sums <= SUMS and rows >= 4 * bins.cells


# ---------------------------------------------------------------------- cells

def _poisson_table() -> np.ndarray:
    """How often a row is drawn for each of 2^16 equally likely numbers."""
    p = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(p, (np.arange(65536) + 0.5) / 65536).astype(np.uint8)


def _class_sums(rows: DataFrame, bins: Bins, classes: int) -> DataFrame:
    """``cell, held, label, n``: the rows of each cell and class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(bins.cells * 2 * classes, np.int64)
        for batch in batches:
            key = (bins.cell(batch) * 2 + batch["held"].to_numpy(zero_copy_only=False)) * classes + batch["label"].to_numpy().astype(np.int64)
            new, n = np.unique(key, return_counts=True)
            times[new] += n
        key = np.flatnonzero(times)
        yield pa.record_batch([pa.array(key // (2 * classes)), pa.array(key // classes % 2 == 1), pa.array((key % classes).astype(np.int32)), pa.array(times[key])], ["cell", "held", "label", "n"])

    counted = rows.mapInArrow(count, "cell long, held boolean, label int, n long")
    return counted.groupBy("cell", "held", "label").agg(F.sum("n").alias("n"))


def _number_sums(rows: DataFrame, bins: Bins, trees: int, seed: int) -> DataFrame:
    """``tree, held, cells, sums``: each task's draws of a tree, their sum and that of squares by cell, as bytes."""
    table = _poisson_table()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        sums: dict[int, np.ndarray] = {}
        size = bins.cells * 2

        def drawn(key: np.ndarray, y: np.ndarray) -> None:
            by = np.argsort(key, kind="stable")
            key, y = key[by], y[by]
            start = np.flatnonzero(np.diff(key, prepend=-1))
            times = table[rng.integers(0, 65536, (trees, len(key)), np.uint16)].astype(np.float64)
            here = key[start]
            for s in range(3):
                sums.setdefault(s, np.zeros((trees, size)))[:, here] += np.add.reduceat(times, start, axis=1)
                times *= y
            return None

        for batch in batches:
            key = bins.cell(batch) * 2 + batch["held"].to_numpy(zero_copy_only=False)
            y = batch["label"].to_numpy()
            for lo in range(0, len(key), DRAWN):
                drawn(key[lo : lo + DRAWN], y[lo : lo + DRAWN])
        if sums:
            for held in (0, 1):
                some = np.flatnonzero(sums[0][:, held::2].any(axis=0))
                at = some * 2 + held
                # by tree: draws, sums, squares
                own = np.stack([sums[s][:, at] for s in range(3)], axis=1)
                cells = some.astype(np.int64).tobytes()
                yield pa.record_batch([pa.array(range(trees), pa.int32()), pa.array([bool(held)] * trees), pa.array([cells] * trees, pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], ["tree", "held", "cells", "sums"])

    return rows.mapInArrow(add, "tree int, held boolean, cells binary, sums binary")


# ---------------------------------------------------------------------- trees

def _impurity(stats: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight and impurity, over the last axis: numbers of classes, or weight, sum and squares."""
    n = stats.sum(axis=-1) if classes else stats[..., 0]
    # draws are whole numbers; sums of none may be left over from rounding
    safe = np.maximum(n, 0.5)
    if classes:
        return n, 1 - ((stats / safe[..., None]) ** 2).sum(axis=-1)
    return n, np.where(n < 0.5, 0.0, np.maximum(stats[..., 2] / safe - (stats[..., 1] / safe) ** 2, 0.0))


def grow(places: np.ndarray, stats: np.ndarray, shape: tuple[int, ...], classes: int, depth: int, least: int, subset: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree from cells: feature (-1 in leaves) and last interval to the left of each node, its statistics, and the
    gain of each feature. Children of node i are 2i + 1 and 2i + 2."""
    size = 2 ** (depth + 1) - 1
    feature, cut = np.full(size, -1, np.int16), np.zeros(size, np.int16)
    node = np.zeros(len(places), np.int64)
    value, won = np.zeros((size, stats.shape[1])), np.zeros(size)
    for level in range(depth + 1):
        base, count = 2**level - 1, 2**level
        here = node >= base
        own, at, mine = node[here] - base, places[here], stats[here]
        total = np.stack([np.bincount(own, mine[:, s], count) for s in range(stats.shape[1])], axis=1)
        value[base : base + count] = total
        if level == depth:
            break
        n, impurity = _impurity(total, classes)
        best, chosen, where = np.zeros(count), np.full(count, -1), np.zeros(count, np.int64)
        allowed = np.argsort(rng.random((count, len(shape))), axis=1).argsort(axis=1) < subset
        for f, bins in enumerate(shape):
            if bins < 2:
                continue
            cells = own * bins + at[:, f]
            hist = np.stack([np.bincount(cells, mine[:, s], count * bins) for s in range(stats.shape[1])], axis=1).reshape(count, bins, -1)
            left = np.cumsum(hist, axis=1)[:, :-1]
            nl, il = _impurity(left, classes)
            nr, ir = _impurity(total[:, None] - left, classes)
            gain = impurity[:, None] - (nl * il + nr * ir) / np.maximum(n, 1e-300)[:, None]
            gain = np.where((nl >= least) & (nr >= least) & allowed[:, f : f + 1], gain, 0.0)
            k = gain.argmax(axis=1)
            g = gain[np.arange(count), k]
            better = g > np.maximum(best, 1e-12 * impurity)
            best[better], chosen[better], where[better] = g[better], f, k[better]
        split = chosen >= 0
        feature[base : base + count], cut[base : base + count] = chosen, where
        won[base : base + count] = best * n
        goes = split[own]
        right = at[np.arange(len(own)), np.maximum(chosen[own], 0)] > where[own]
        node[np.flatnonzero(here)[goes]] = 2 * (own[goes] + base) + 1 + right[goes]
        # rows of a leaf stay behind
        node[np.flatnonzero(here)[~goes]] = -1
    # leaves of one parent that say the same are one leaf
    says = value.argmax(axis=1) if classes else value[:, 1] / np.maximum(value[:, 0], 0.5)
    for i in reversed(range(2**depth - 1)):
        if feature[i] >= 0 and (feature[2 * i + 1 : 2 * i + 3] < 0).all() and says[2 * i + 1] == says[2 * i + 2]:
            feature[i] = -1
    gains = np.zeros(len(shape))
    np.add.at(gains, feature[feature >= 0], won[feature >= 0])
    return feature, cut, value, gains


@dataclass
class Forest:
    """Trees over cells: their features, cuts and what each node says: shares of the classes, or a mean."""

    bins: Bins
    classes: int
    feature: np.ndarray
    cut: np.ndarray
    says: np.ndarray
    gains: np.ndarray

    @property
    def featureImportances(self) -> DenseVector:
        each = self.gains / np.maximum(self.gains.sum(axis=1, keepdims=True), 1e-300)
        total = each.sum(axis=0)
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def predict(self, cells: np.ndarray) -> np.ndarray:
        """The mean of the trees by cell: shares of the classes, or one number."""
        places = self.bins.places(cells)
        out = np.zeros((len(cells), self.says.shape[2]))
        rows = np.arange(len(cells))
        for feature, cut, says in zip(self.feature, self.cut, self.says):
            node = np.zeros(len(cells), np.int64)
            while (inner := feature[node] >= 0).any():
                right = places[rows, np.maximum(feature[node], 0)] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += says[node]
        return out / len(self.feature)

    def transform(self, df: DataFrame) -> DataFrame:
        """The columns of ``df`` but its vectors, with ``prediction`` and, of classes, ``score``, the share of the second."""
        df = df.drop("features")
        more = ", prediction double" + (", score double" if self.classes else "")
        shape = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(df.columns, df.schema)) + more

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells, at = np.unique(self.bins.cell(batch), return_inverse=True)
                said = self.predict(cells)
                columns = [said.argmax(axis=1).astype(np.float64), said[:, 1] if said.shape[1] > 1 else np.zeros(len(said))] if self.classes else [said[:, 0]]
                names = ["prediction", "score"][: len(columns)]
                yield pa.record_batch([*batch.columns, *[pa.array(c[at]) for c in columns]], [*batch.schema.names, *names])

        return df.mapInArrow(run, shape)


def fit(
    rows: DataFrame, held: Column, bins: Bins, *, classes: int, trees: int, depth: int, seed: int, least: int = 1, both: bool = True
) -> tuple[Forest, Forest | None]:
    """Forests over all rows and, with ``both``, over those that are not ``held``; ``rows`` have label and the features.

    Numbers are drawn from the seed and the partition of a row, classes from the seed alone.
    """
    frame = rows.select(held.alias("held"), F.col("label").cast("double").alias("label"), *[f"x_{c}" for c in bins.features])
    width = len(bins.features)
    subset = math.ceil(math.sqrt(width)) if classes else width
    spark = rows.sparkSession
    if classes:
        sums = materialise(_class_sums(frame, bins, classes), "cells")

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.record_batch([pa.array([c.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for c in b.columns], ["cell", "held", "label", "n"])

        work = min(trees, 2 * spark.sparkContext.defaultParallelism)
        chunks = sums.mapInArrow(packed, "cell binary, held binary, label binary, n binary")
        chunks = chunks.select("*", F.explode(F.sequence(F.lit(0), F.lit(work - 1))).alias("_work"))
    else:
        work = trees
        chunks = materialise(_number_sums(frame, bins, trees, seed), "cells").withColumn("_work", F.col("tree"))

    def stats(chunk: pa.Table, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells and their statistics by held or not, class or moment."""
        if classes:
            cell, is_held, label, n = (np.frombuffer(b"".join(chunk[c].to_pylist()), np.int64) for c in ("cell", "held", "label", "n"))
            by = np.lexsort((label, is_held, cell))
            cells, at = np.unique(cell[by], return_inverse=True)
            out = np.zeros((len(cells), 2, classes))
            out[at, is_held[by], label[by]] = np.random.default_rng([seed, tree]).poisson(n[by])
            return cells, out
        parts = [(np.frombuffer(r["cells"], np.int64), int(r["held"]), np.frombuffer(r["sums"]).reshape(3, -1)) for r in chunk.to_pylist()]
        cells, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        out, lo = np.zeros((len(cells), 2, 3)), 0
        for own, h, sums_ in parts:
            # a task names a cell once
            out[at[lo : lo + len(own)], h] += sums_.T
            lo += len(own)
        return cells, out

    def train(chunk: pa.Table) -> pa.Table:
        out = []
        mine = chunk["_work"][0].as_py()
        for tree in range(mine, trees, work):
            cells, own = stats(chunk, tree)
            places = bins.places(cells)
            for which in range(2 if both else 1):
                use = own.sum(axis=1) if which == 0 else own[:, 0]
                rng = np.random.default_rng([seed, tree, which])
                feature, cut, value, gains = grow(places, use, bins.shape, classes, depth, least, subset, rng)
                weight = np.maximum(value.sum(axis=1) if classes else value[:, 0], 1e-300)
                says = value / weight[:, None] if classes else (value[:, 1] / weight)[:, None]
                out.append((tree, which, feature.tobytes(), cut.tobytes(), says.tobytes(), gains.tobytes()))
        names = ["tree", "which", "feature", "cut", "says", "gains"]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    grown = chunks.groupBy("_work").applyInArrow(train, "tree int, which int, feature binary, cut binary, says binary, gains binary").collect()
    size, found = 2 ** (depth + 1) - 1, []
    for which in range(2 if both else 1):
        own = sorted((r for r in grown if r["which"] == which), key=lambda r: r["tree"])
        feature, cut = (np.stack([np.frombuffer(r[c], np.int16) for r in own]) for c in ("feature", "cut"))
        says = np.stack([np.frombuffer(r["says"]).reshape(size, -1) for r in own])
        found.append(Forest(bins, classes, feature, cut, says, np.stack([np.frombuffer(r["gains"]) for r in own])))
    return found[0], found[1] if both else None
