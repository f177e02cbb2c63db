"""Coordinate expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridspark.functions.missing import _col


def wrap_lon(lon: Column | str) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(_col(lon) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def inside(lat: Column | str, lon: Column | str, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> Column:
    """Both ends inclusive."""
    return _col(lat).between(lat_min, lat_max) & _col(lon).between(lon_min, lon_max)
