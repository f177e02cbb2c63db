"""Projections, renames and crops."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gridspark.functions.geo import inside

# The spellings of dimension and variable names met in source files.
CANONICAL = {
    "valid_time": "time",
    "latitude": "lat",
    "longitude": "lon",
    "Latitude": "lat",
    "Longitude": "lon",
    "si10": "windspeed",
}


def canonicalise(df: DataFrame, mapping: Mapping[str, str] = CANONICAL) -> DataFrame:
    """Rename whatever of the mapping is present (B2)."""
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns})


def select_vars(df: DataFrame, variables: Iterable[str], keys: Iterable[str] = ("time", "t", "i", "j", "lat", "lon")) -> DataFrame:
    """Key columns that exist plus the requested variables (B1)."""
    return df.select(*(k for k in keys if k in df.columns), *variables)


def with_optional(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Auxiliary variables: kept when present, NULL of the given type otherwise."""
    absent = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def crop_bbox(df: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float,
              lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Label crop, both ends inclusive, any axis direction."""
    return df.filter(inside(lat, lon, lat_min, lat_max, lon_min, lon_max))


def crop_index(df: DataFrame, i: tuple[int, int], j: tuple[int, int]) -> DataFrame:
    """Positional crop, half open."""
    return df.filter((F.col("i") >= i[0]) & (F.col("i") < i[1]) & (F.col("j") >= j[0]) & (F.col("j") < j[1]))


def time_slice(df: DataFrame, start: int, n: int) -> DataFrame:
    """Steps start .. start+n-1."""
    return df.filter((F.col("t") >= start) & (F.col("t") < start + n))


def first_step(df: DataFrame, step: str = "t") -> DataFrame:
    """Rows of the earliest step."""
    return df.filter(F.col(step) == df.agg(F.min(step)).scalar())


def last_step(df: DataFrame, step: str = "t") -> DataFrame:
    """Rows of the latest step."""
    return df.filter(F.col(step) == df.agg(F.max(step)).scalar())


def to_float32(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Single precision for storage (B13); by default all double columns except coordinates."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType) and f.name not in ("lat", "lon")]
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def apply_cells(df: DataFrame, fn: Callable[..., pd.Series], columns: Iterable[str], out: str,
                out_type: str = "double") -> DataFrame:
    """User function over aligned cells, whole Arrow batches at a time.

    For functions Spark's own expressions cannot state; prefer those where they can.
    """
    return df.withColumn(out, F.pandas_udf(fn, out_type)(*(F.col(c) for c in columns)))


def reduction_ratio(whole: DataFrame, part: DataFrame) -> DataFrame:
    """Cells of the whole per cell of the part (D17), one row."""
    return whole.agg(F.count(F.lit(1)).alias("whole_cells")).select(
        "whole_cells", part.agg(F.count(F.lit(1))).scalar().alias("part_cells")
    ).withColumn("ratio", F.try_divide(F.col("whole_cells").cast("double"), F.col("part_cells").cast("double")))
