"""Parquet, JSON and CSV sinks and the append-only report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def append_report(df: DataFrame, path: str, dataset_id: str) -> str:
    """Append profile, quality or question-log rows, one partition per dataset."""
    stamped = df.withColumn("recorded_at", F.current_timestamp()).withColumn("dataset_id", F.lit(dataset_id))
    stamped.write.mode("append").partitionBy("dataset_id").parquet(path)
    return path


def read_report(spark: SparkSession, path: str, dataset_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if dataset_id is None else df.filter(F.col("dataset_id") == dataset_id)
