"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.scratch import materialise


#: edges that one task follows to the end; more are followed in rounds over all tasks
FEW = 20_000


def _top(parent: dict[int, int], x: int) -> int:
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = parent[up]
        x = up
    return x


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes: each task keeps those that join two of its trees.

    All edges from one ``a`` meet in a task, so a node with several edges to the same group keeps about one of them.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = _top(parent, a), _top(parent, b)
                keep.append(x != y)
                parent[max(x, y)] = min(x, y)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return edges.select("a", "b").repartition("a").mapInArrow(scan, "a long, b long")


def _few(edges: DataFrame) -> DataFrame:
    """``components`` of at most ``FEW`` edges, in one task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = _top(parent, a), _top(parent, b)
                parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([_top(parent, x) for x in nodes], pa.int64())], ["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(scan, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b): root is the smallest node of its component.

    Only a forest of the edges is followed. Each round takes the smallest label over all edges (summed up before the shuffle, so a node with very many
    edges is one row per task), then follows labels to their labels. Rounds are logarithmic in the longest chain.
    A forest of at most ``FEW`` edges is no work for many tasks and many rounds: one task follows it.
    """
    trees = materialise(forest(edges), "forest")
    if trees.count() <= FEW:
        return materialise(_few(trees), "labels")
    near = trees.select(F.col("a").alias("u"), F.col("b").alias("v"))
    near = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # an edge to itself brings a node's own label along
    both = materialise(near.unionByName(near.select("u", F.col("u").alias("v"))).distinct(), "edges")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node"), "labels")
    while True:
        own = F.max(F.when(F.col("u") == F.col("v"), F.col("root"))).alias("_old")
        step = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("_r"), own)
        up = labels.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
        new = materialise(step.join(up, F.col("_r") == F.col("_n")).select(F.col("u").alias("node"), "_old", F.least("_r", "_up").alias("root")), "labels")
        labels = new.select("node", "root")
        if new.filter("root <> _old").isEmpty():
            return labels
