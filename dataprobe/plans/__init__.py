"""Registered queries: each wires an operator to the given tables and states the same result in SQL."""

from __future__ import annotations

import importlib

AREAS = (
    "scans", "shaping", "joins", "aggregates", "series_windows", "ranking", "scalars", "profiling", "business", "forecasting", "segments", "modelling", "causes", "questions", "search", "raw_series", "exact",
)


def load() -> None:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
