"""Axes, calendars and whole grids."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gridspark.operators.merge import one_value
from gridspark.operators.running import rank_distinct
from gridspark.operators.small import join_small


@dataclass(frozen=True)
class Axis:
    """A coordinate axis: a table `(idx INT, coord DOUBLE)` and its length."""

    table: DataFrame
    size: int


def regular_axis(spark: SparkSession, lo: float, hi: float, res: float, centred: bool = False,
                 decimals: int | None = 2) -> Axis:
    """Evenly spaced axis.

    Inclusive: lo, lo+res, ... up to hi, rounded. Centred: cell centres between lo and hi.
    Coordinates are computed from the integer index, never accumulated.
    """
    start, stop = (lo + res / 2, hi) if centred else (lo, hi + res / 2)
    size = max(0, math.ceil(round((stop - start) / res, 9)))
    coord: Column = F.lit(float(start)) + F.col("id") * F.lit(float(res))
    if decimals is not None and not centred:
        coord = F.round(coord, decimals)
    return Axis(spark.range(size).select(F.col("id").cast("int").alias("idx"), coord.alias("coord")), size)


def axis_of(df: DataFrame, idx: str, coord: str) -> Axis:
    """The axis used by a cube, read from its index and coordinate columns."""
    table = df.groupBy(F.col(idx).alias("idx")).agg(F.max(F.col(coord).cast("double")).alias("coord"))
    return Axis(table, table.count())


def sort_axis(df: DataFrame, coord: str, idx: str) -> DataFrame:
    """(Re)number cells by ascending coordinate (B4, B8) without sorting the cells.

    Only the distinct coordinates are ranked, block by block, so an axis may have as many
    positions as there are cells (swath coordinates). Cells without a coordinate have no place.
    """
    return join_small(df.drop(idx), rank_distinct(df, coord, idx), coord)


def shared_axis(df: DataFrame, coord: str, idx: str, tolerance: float) -> DataFrame:
    """One ascending axis from the coordinates of many files (A2): `(coord, idx, _least_coord)` for every distinct coordinate.

    Coordinates that lie within the tolerance of the next lower one are one position, whose
    coordinate is the least of them; files may list them in either direction and overlap in part.
    """
    ranked = rank_distinct(df, coord, idx, tolerance)
    least = ranked.groupBy(idx).agg(F.min(coord).alias(f"_least_{coord}"))
    return join_small(ranked, least, idx)


def block_factor(df: DataFrame, lat: str, lon: str, res: float) -> DataFrame:
    """How many source cells make one target cell (B21): one row, half rounded to even.

    The spacing is that of the first two coordinates of each axis. The cells are read once.
    """
    both = F.array(F.struct(F.lit("lat").alias("axis"), F.col(lat).cast("double").alias("coord")),
                   F.struct(F.lit("lon").alias("axis"), F.col(lon).cast("double").alias("coord")))
    coords = df.select(F.explode(both).alias("p")).select("p.*").distinct()
    place = F.row_number().over(W.partitionBy("axis").orderBy("coord"))
    spacing = coords.withColumn("place", place).filter("place <= 2").groupBy("axis").agg((F.max("coord") - F.min("coord")).alias("step"))
    return spacing.agg(F.bround(F.lit(float(res)) / F.min("step"), 0).cast("int").alias("factor"))


def calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Every day from start to end, both included (B17); leap days are kept."""
    return spark.range(calendar_length(start, end)).select(
        F.date_add(F.lit(start), F.col("id").cast("int")).alias("time")
    )


def calendar_length(start: date, end: date) -> int:
    return max(0, (end - start).days + 1)


def grid(spark: SparkSession, n_lat: int, n_lon: int, n_time: int | None = None) -> DataFrame:
    """All index positions of a grid, generated in place from a range: no cross join, no shuffle."""
    cells = n_lat * n_lon
    n = F.col("id")
    position = [
        F.expr(f"id % {cells} div {n_lon}").cast("int").alias("i"),
        F.expr(f"id % {n_lon}").cast("int").alias("j"),
    ]
    if n_time is None:
        return spark.range(cells).select(*position)
    return spark.range(cells * n_time).select(F.floor(n / F.lit(cells)).cast("int").alias("t"), *position)


def densify(df: DataFrame, n_lat: int, n_lon: int, n_time: int) -> DataFrame:
    """Sparse cells to the full grid, missing where there was no row.

    Grid and data are stacked and grouped, which combines on the map side; a join would not.
    """
    keys = ["t", "i", "j"]
    values = [c for c in df.columns if c not in keys]
    full = grid(df.sparkSession, n_lat, n_lon, n_time)
    return (
        full.unionByName(df.select(*keys, *values), allowMissingColumns=True)
        .groupBy(*keys)
        .agg(*(one_value(df, c).alias(c) for c in values))
    )


def with_coordinates(df: DataFrame, lat: Axis, lon: Axis) -> DataFrame:
    """Attach `lat` and `lon` to cells keyed by `i` and `j`."""
    lats = lat.table.select(F.col("idx").alias("i"), F.col("coord").alias("lat"))
    lons = lon.table.select(F.col("idx").alias("j"), F.col("coord").alias("lon"))
    return join_small(join_small(df, lats, "i", rows=lat.size), lons, "j", rows=lon.size)
