"""The key at a position of a total order, found by counting; rows are neither shuffled nor written.

A position becomes a comparison with the key that stands there. The key is narrowed from a sample: some thousand keys
that lie between the bounds give two closer bounds around the wanted rank, and one scan counts what lies
below and between them. Each step leaves about one row in thirty; the last few thousand keys are sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: keys that a sample holds, and as few as are fetched and sorted in the end
SAMPLE = 20_000


def order_key(order_by: list[str]) -> Column:
    """A struct that compares like the columns in order, nulls last."""
    return F.struct(*[x for i, c in enumerate(order_by) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))])


class _Search:
    """One group's bounds: the wanted key is the ``rank``-th (from 1) of ``inside`` keys strictly between ``lo`` and ``hi``."""

    def __init__(self, group, rank: int, size: int):
        self.group, self.rank, self.inside = group, rank, size
        self.lo = self.hi = self.key = None


def keys_at(df: DataFrame, order_by: list[str], ranks: dict, *, group: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """``_group, _key``: for each group of ``ranks`` ({group: (rank, rows of the group)}, group None for the whole table)
    the ``order_key`` of its row at that rank. One row per group; ``order_by`` ends in a unique key."""
    spark = df.sparkSession
    rows = df.select((F.col(group) if group else F.lit(None).cast("int")).alias("_group"), order_key(order_by).alias("_key"))
    kind = T.StructType([rows.schema["_group"], rows.schema["_key"]])
    searches = [_Search(g, rank, size) for g, (rank, size) in ranks.items()]
    turn = 0
    while open_ := [s for s in searches if s.key is None and s.inside > sample]:
        turn += 1
        _narrow(rows, open_, kind, turn, sample)
    rest = [s for s in searches if s.key is None]
    if rest:
        # at most ``sample`` keys per group
        for s, keys in zip(rest, _between(rows, rest, kind, None, 0)):
            s.key = keys[s.rank - 1]
    return spark.createDataFrame([(s.group, s.key) for s in searches], T.StructType([T.StructField("_group", kind["_group"].dataType), T.StructField("_key", kind["_key"].dataType)]))


def _with_bounds(rows: DataFrame, searches: list[_Search], kind: T.StructType) -> DataFrame:
    """The rows of the searched groups between their bounds, with ``_s``, the place of the search."""
    key = kind["_key"].dataType
    schema = T.StructType([T.StructField("_g", kind["_group"].dataType), T.StructField("_s", T.IntegerType()), T.StructField("_lo", key), T.StructField("_hi", key)])
    # one row per group that is searched
    bounds = rows.sparkSession.createDataFrame([(s.group, i, s.lo, s.hi) for i, s in enumerate(searches)], schema)
    met = rows.join(F.broadcast(bounds), rows["_group"].eqNullSafe(bounds["_g"]))
    return met.filter((F.col("_lo").isNull() | (F.col("_key") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_key") < F.col("_hi"))))


def _between(rows: DataFrame, searches: list[_Search], kind: T.StructType, share: dict[int, float] | None, turn: int) -> list[list]:
    """The keys between each search's bounds in order, all or a random share of them."""
    met = _with_bounds(rows, searches, kind)
    if share is not None:
        limit = F.element_at(F.create_map(*[F.lit(x) for i, p in share.items() for x in (i, p)]), F.col("_s"))
        # by row, so that equal keys are not all in or out; another sample on a re-run proposes other bounds for the same result
        met = met.filter(F.rand(turn) < limit)
    out: list[list] = [[] for _ in searches]
    for r in met.select("_s", "_key").orderBy("_s", "_key").collect():
        out[r["_s"]].append(r["_key"])
    return out


def _narrow(rows: DataFrame, searches: list[_Search], kind: T.StructType, turn: int, sample: int) -> None:
    """Closer bounds from a sample; one scan counts below, at and above them, and the rank tells where to go on."""
    chosen = _between(rows, searches, kind, {i: sample / s.inside for i, s in enumerate(searches)}, turn)
    new = []
    for i, (s, keys) in enumerate(zip(searches, chosen)):
        at, slack = (s.rank - 0.5) / s.inside * len(keys), 2 * math.sqrt(len(keys)) + 2
        a, b = math.floor(at - slack), math.ceil(at + slack)
        new.append((i, keys[a] if a >= 0 else None, keys[b] if b < len(keys) else None))
    schema = T.StructType([T.StructField("_i", T.IntegerType()), T.StructField("_a", kind["_key"].dataType), T.StructField("_b", kind["_key"].dataType)])
    met = _with_bounds(rows, searches, kind).join(F.broadcast(rows.sparkSession.createDataFrame(new, schema)), F.col("_s") == F.col("_i"))
    key, below, above = F.col("_key"), F.col("_a"), F.col("_b")
    counts = met.groupBy("_s").agg(
        F.count_if(key < below).alias("under"), F.count_if(key == below).alias("at_a"), F.count_if(key == above).alias("at_b"), F.count_if(key > above).alias("over"), F.count("*").alias("n"),
    )
    for r in counts.collect():
        s, (_, a, b) = searches[r["_s"]], new[r["_s"]]
        upto_a, before_b = r["under"] + r["at_a"], r["n"] - r["over"] - r["at_b"]
        if s.rank <= r["under"]:
            s.hi, s.inside = a, r["under"]
        elif s.rank <= upto_a:
            s.key = a
        elif a is not None and a == b:  # the rank lies above the one key that both bounds are
            s.lo, s.rank, s.inside = b, s.rank - upto_a, r["over"]
        elif s.rank <= before_b:
            s.lo, s.hi, s.rank, s.inside = s.lo if a is None else a, s.hi if b is None else b, s.rank - upto_a, before_b - upto_a
        elif s.rank <= before_b + r["at_b"]:
            s.key = b
        else:
            s.lo, s.rank, s.inside = b, s.rank - before_b - r["at_b"], r["over"]


def first_rows(df: DataFrame, order_by: list[str], wanted: int, total: int, **kw) -> DataFrame:
    """``df`` with ``_first``, whether a row is among the first ``wanted`` of all ``total`` in order."""
    if wanted <= 0 or total == 0:
        return df.withColumn("_first", F.lit(False))
    if wanted >= total:
        return df.withColumn("_first", F.lit(True))
    cut = keys_at(df, order_by, {None: (wanted, total)}, **kw).select("_key")
    return df.crossJoin(F.broadcast(cut)).withColumn("_first", order_key(order_by) <= F.col("_key")).drop("_key")


def first_rows_of_groups(df: DataFrame, group: str, order_by: list[str], share: float, **kw) -> DataFrame:
    """``df`` with ``_first``: the first ``ceil(n * share)`` rows of each group in order; few groups, one row of counts each."""
    sizes = {r[group]: r["n"] for r in df.groupBy(group).agg(F.count("*").alias("n")).collect()}
    ranks = {g: (min(n, math.ceil(n * share)), n) for g, n in sizes.items()}
    if share <= 0 or not ranks:
        return df.withColumn("_first", F.lit(False))
    cut = keys_at(df, order_by, ranks, group=group, **kw)
    return df.join(F.broadcast(cut), df[group].eqNullSafe(cut["_group"])).withColumn("_first", order_key(order_by) <= F.col("_key")).drop("_group", "_key")
