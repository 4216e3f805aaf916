"""Written tables that cut lineage.

A step that must see the same rows twice (a range split followed by per-split offsets, a fitted model's
input, a table used by several branches) is written once and read back, so that losing an executor never
changes what the second reader sees. The folder is the one named in ``spark.checkpoint.dir``; only a local session
without that setting gets a temporary one.

Written tables outlive the call, since its result is read later. ``scope`` bounds them: tables written inside are
deleted when it ends, so results must be written or collected before.

    with scope(spark):
        clean(df).write.parquet(path)
"""

from __future__ import annotations

import math
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="dataprobe-")


class _Scopes(threading.local):
    """The open scopes of one thread."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_scopes = _Scopes()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that this thread writes inside, through the file system that holds them."""
    paths: list[str] = []
    _scopes.open.append(paths)
    try:
        yield
    finally:
        _scopes.open.remove(paths)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one written table."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base()
    path = f"{base.rstrip('/')}/dataprobe-{label}-{uuid.uuid4().hex}"
    if _scopes.open:
        _scopes.open[-1].append(path)
    return path


def materialise(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, most: int | None = None) -> DataFrame:
    """At least one partition per core, for steps that compute far more than they read.

    A table written after a join may be a few small files; a large one already has more splits than cores. ``most``
    bounds the rows of a partition, for steps that keep far more of a row in memory than its file does.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    if most is not None:
        parts = max(parts, math.ceil(df.count() / most))
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)
