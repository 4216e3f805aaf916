"""Severity and impact ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step the value exceeds."""
    out = None
    for bound, name in steps:
        out = F.when(value > bound, name) if out is None else out.when(value > bound, name)
    return out.otherwise(otherwise)


def severity(change_percent: Column, score: Column) -> Column:
    """Critical, Medium or Low from the size of the change or the anomaly score."""
    size, s = F.abs(change_percent), F.coalesce(score, F.lit(0.0))
    return F.when((size > 40) | (s > 0.65), "Critical").when((size > 25) | (s > 0.55), "Medium").otherwise("Low")
