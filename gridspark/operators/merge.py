"""Putting cubes together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.functions.missing import nan_to_null


def concat_time(cubes: Sequence[DataFrame]) -> DataFrame:
    """One cube from pieces that follow each other in time (A3); columns may differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cubes)


def merge_cubes(cubes: Sequence[DataFrame], keys: Sequence[str] = ("t", "i", "j")) -> DataFrame:
    """Variables of several cubes side by side on the union of their coordinates (C4).

    Stacking and grouping costs one shuffle of map-side combined rows where a chain of outer
    joins would cost one per cube. Two different values of one variable in a cell are an error;
    `merge_conflicts` lists them.
    """
    stacked = concat_time(cubes)
    return stacked.groupBy(*keys).agg(*(one_value(stacked, v).alias(v) for v in stacked.columns if v not in keys))


def _known(df: DataFrame, v: str) -> Column:
    return nan_to_null(v) if dict(df.dtypes)[v] in ("float", "double") else F.col(v)


def one_value(df: DataFrame, v: str) -> Column:
    """Aggregate: the value that all rows of a group agree on, missing ones aside; an error if they differ."""
    least, most = F.min(_known(df, v)), F.max(_known(df, v))
    differ = F.raise_error(F.concat(F.lit(f"different values of {v} in a cell: "), least.cast("string"), F.lit(", "), most.cast("string")))
    return F.when(least != most, differ.cast(df.schema[v].dataType)).otherwise(most)


def merge_conflicts(cubes: Sequence[DataFrame], keys: Sequence[str] = ("t", "i", "j")) -> DataFrame:
    """Cells in which cubes differ: the keys, `variable`, `lowest`, `highest`."""
    stacked = concat_time(cubes)
    values = [c for c in stacked.columns if c not in keys]
    ends = stacked.groupBy(*keys).agg(*(f(_known(stacked, v)).cast("double").alias(f"{n}_{v}") for v in values for n, f in (("lo", F.min), ("hi", F.max))))
    pairs = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(f"lo_{v}").alias("lowest"), F.col(f"hi_{v}").alias("highest")) for v in values))
    return ends.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*").filter("lowest <> highest")


def check_alignment(cubes: dict[str, DataFrame], rtol: float = 1e-5, atol: float = 1e-8, time: str = "time") -> DataFrame:
    """Axes of every cube against those of the first (C5): `(dataset, axis, n_mismatch)`.

    Latitudes and longitudes are compared position by position within the tolerance, times
    exactly; a position only one side has is a mismatch. Each cube is read once, and the axes of
    all are compared in one grouping.
    """
    names = list(cubes)
    positions = F.array(
        F.struct(F.lit("lat").alias("axis"), F.col("i").cast("long").alias("pos"), F.col("lat").cast("double").alias("coord")),
        F.struct(F.lit("lon").alias("axis"), F.col("j").cast("long").alias("pos"), F.col("lon").cast("double").alias("coord")),
        F.struct(F.lit("time").alias("axis"), F.unix_date(time).cast("long").alias("pos"), F.lit(0.0).alias("coord")),
    )
    stacked = reduce(DataFrame.unionByName, (cubes[n].select(F.lit(k).alias("cube"), F.explode(positions).alias("p")).select("cube", "p.*") for k, n in enumerate(names)))
    own = lambda k: F.max(F.when(F.col("cube") == k, F.struct("coord"))).alias(f"c{k}")
    wide = stacked.groupBy("axis", "pos").agg(*(own(k) for k in range(len(names))))
    pairs = F.array(*(F.struct(F.lit(n).alias("dataset"), F.col(f"c{k}").alias("b")) for k, n in enumerate(names) if k))
    both = wide.select("axis", F.col("c0").alias("a"), F.explode(pairs).alias("p")).select("axis", "a", "p.*").filter("a is not null or b is not null")
    close = F.abs(F.col("a.coord") - F.col("b.coord")) <= F.lit(atol) + F.lit(rtol) * F.abs(F.col("b.coord"))
    return both.groupBy("dataset", "axis").agg(F.count_if(~F.coalesce(close, F.lit(False))).alias("n_mismatch"))
