"""Exact quantiles with linear interpolation, by narrowing.

A sketch gives, for each wanted rank, two values that the rank must lie between; rows outside are only counted.
While more than ``inside`` rows lie strictly between, the sketch is taken again over them alone (each step leaves
about one in a thousand), so no task ever holds more than sketches and, at the end, few different values per rank.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.numeric import as_double

INSIDE = 20_000
ACCURACY = 10_000


@dataclass
class _Target:
    """A column's rank (from 0): its value lies in ``lo`` to ``hi``, and ``below`` rows lie below ``lo``."""

    column: str
    rank: int
    total: int
    lo: float | None = None
    hi: float | None = None
    below: int = 0
    at_lo: int = 0
    inner: int = 0


def quantile_row(df: DataFrame, columns: list[str], probs: list[float], *, inside: int = INSIDE, accuracy: int = ACCURACY, rows: int | None = None) -> DataFrame:
    """One row; for each column an array of its quantiles in the order of ``probs``, null without values.

    ``rows`` is accepted for callers that know the size; every size takes the same way.
    """
    spark = df.sparkSession
    if not columns:
        return spark.range(1).select()
    base = df.select(*[as_double(c).alias(c) for c in columns])
    sizes = base.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).first()
    targets: dict[tuple[str, int], _Target] = {}
    for c in columns:
        for p in probs:
            if sizes[c]:
                pos = (sizes[c] - 1) * p
                for r in {math.floor(pos), math.ceil(pos)}:
                    targets[c, r] = _Target(c, r, sizes[c], inner=sizes[c])
    open_ = list(targets.values())
    while open_:
        _narrow(base, open_, accuracy)
        open_ = [t for t in open_ if t.inner > inside]
    found = _pick(base, list(targets.values())) if targets else {}

    def value(c: str, p: float) -> float | None:
        if not sizes[c]:
            return None
        pos = (sizes[c] - 1) * p
        lo, hi = found[c, math.floor(pos)], found[c, math.ceil(pos)]
        return lo + (hi - lo) * (pos - math.floor(pos))

    schema = ", ".join(f"`{c}` array<double>" for c in columns)
    return spark.createDataFrame([tuple([value(c, p) for p in probs] if sizes[c] else None for c in columns)], schema)


def _between(t: _Target) -> Column:
    """The values strictly between the bounds; all at the start."""
    v = F.col(f"`{t.column}`")
    return F.lit(True) if t.lo is None else (v > t.lo) & (v < t.hi)


def _narrow(base: DataFrame, targets: list[_Target], accuracy: int) -> None:
    """Set bounds around each rank from a sketch of the rows between the old ones, and count against them."""
    slack = lambda t: 2 * math.ceil(t.inner / accuracy) + 1
    exprs = []
    for i, t in enumerate(targets):
        first = t.rank - t.below - t.at_lo  # the rank among the rows strictly between
        share = [max(0.0, (first - slack(t)) / t.inner), min(1.0, (first + 1 + slack(t)) / t.inner)]
        exprs.append(F.percentile_approx(F.when(_between(t), F.col(f"`{t.column}`")), F.array(*map(F.lit, share)), accuracy).alias(f"q{i}"))
    bounds = base.agg(*exprs).first()
    for i, t in enumerate(targets):
        t.lo, t.hi = bounds[f"q{i}"]
    _count(base, targets)


def _count(base: DataFrame, targets: list[_Target]) -> None:
    """Rows below, at and strictly between the bounds; a rank at a bound is settled."""
    exprs = []
    for i, t in enumerate(targets):
        v = F.col(f"`{t.column}`")
        exprs += [F.count_if(v < t.lo).alias(f"b{i}"), F.count_if(v == t.lo).alias(f"l{i}"), F.count_if((v > t.lo) & (v < t.hi)).alias(f"i{i}")]
    row = base.agg(*exprs).first()
    for i, t in enumerate(targets):
        t.below, t.at_lo, t.inner = row[f"b{i}"], row[f"l{i}"], row[f"i{i}"]
        if t.below <= t.rank < t.below + t.at_lo:
            t.hi, t.inner = t.lo, 0
        elif t.rank >= t.below + t.at_lo + t.inner:
            t.below += t.at_lo + t.inner
            t.lo, t.at_lo, t.inner = t.hi, t.total, 0


def _pick(base: DataFrame, targets: list[_Target]) -> dict[tuple[str, int], float]:
    """The value at each rank: the bound itself, or one of the few values between the bounds."""
    out = {(t.column, t.rank): t.lo for t in targets if t.inner == 0}
    rest = [t for t in targets if t.inner]
    if rest:
        hits = [F.when(_between(t), F.struct(F.lit(i).alias("i"), F.col(f"`{t.column}`").alias("v"))) for i, t in enumerate(rest)]
        inner = base.select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("x")).select("x.*").groupBy("i", "v").agg(F.count("*").alias("n"))
        upto = [t.below + t.at_lo for t in rest]
        # at most ``inside`` rows per wanted rank
        for r in inner.orderBy("i", "v").toLocalIterator():
            t = rest[r["i"]]
            if upto[r["i"]] <= t.rank < upto[r["i"]] + r["n"]:
                out[t.column, t.rank] = r["v"]
            upto[r["i"]] += r["n"]
    return out


def median_row(df: DataFrame, columns: list[str], **kw) -> DataFrame:
    """One row with the median of each column."""
    row = quantile_row(df, columns, [0.5], **kw)
    return row.select(*[F.col(f"`{c}`")[0].alias(c) for c in columns])
