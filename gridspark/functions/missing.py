"""Missing values have one spelling inside the library: NULL.

Spark's `avg`, `max` and `count` treat NaN as a value, so NaN, infinities and
sentinels are turned into NULL at the source.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def finite_or_null(c: Column | str) -> Column:
    value = nan_to_null(c)
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def null_if(c: Column | str, sentinels: Iterable[float]) -> Column:
    """NULL where the value equals one of the sentinels."""
    value = _col(c)
    return F.when(~value.isin(*sentinels), value)


def decode_packed(c: Column | str, scale: float = 1.0, offset: float = 0.0) -> Column:
    """Packed integer to physical value (B9). Apply once, on raw values only."""
    return _col(c) * F.lit(float(scale)) + F.lit(float(offset))


def mask_quality(df: DataFrame, value: str, flag: str, good: int = 0) -> DataFrame:
    """Keep `value` only where the flag is good; unchanged if there is no flag column."""
    if flag not in df.columns:
        return df
    return df.withColumn(value, F.when(F.col(flag).eqNullSafe(F.lit(good)), F.col(value)))


def fill_missing(df: DataFrame, columns: Iterable[str], value: float = 0.0) -> DataFrame:
    """Missing, NaN and infinite values become a constant for model input."""
    return df.withColumns({c: F.coalesce(finite_or_null(c), F.lit(float(value))) for c in columns})


def normalise(df: DataFrame, columns: Iterable[str], sentinels: Iterable[float] = ()) -> DataFrame:
    """One spelling of missing for all the given value columns."""
    sentinels = list(sentinels)

    def clean(c: str) -> Column:
        value = nan_to_null(c)
        return null_if(value, sentinels) if sentinels else value

    return df.withColumns({c: clean(c) for c in columns})
