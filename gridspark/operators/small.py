"""Joins against a side that is expected to be small, with the expectation checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_BROADCAST_ROWS = 500_000


def join_small(df: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str = "inner",
               rows: int | None = None) -> DataFrame:
    """Join `df` with `small`, broadcasting it if a bound known beforehand allows.

    `rows` is that bound (an axis or calendar length, a number of features). Without it, or
    beyond the limit, Spark picks the join from the sizes it finds at run time and splits
    skewed partitions. The rows are the same either way, and no job runs while the plan is built.
    """
    return df.join(F.broadcast(small) if rows is not None and rows <= MAX_BROADCAST_ROWS else small, on, how)
