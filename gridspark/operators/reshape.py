"""Channel stacks and frame shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridspark.operators.small import join_small

def to_wide(long: DataFrame, channels: Sequence[str], keys: Sequence[str], var: str = "var", value: str = "value",
            prefix: str = "") -> DataFrame:
    """One row per cell, one column per channel. The channel list is fixed, so no extra pass looks for it."""
    return long.groupBy(*keys).agg(
        *(F.max(F.when(F.col(var) == c, F.col(value))).alias(prefix + c) for c in channels)
    )


def to_long(wide: DataFrame, channels: Sequence[str], var: str = "var", value: str = "value",
            keep_missing: bool = False) -> DataFrame:
    """One row per cell and channel."""
    keys = [c for c in wide.columns if c not in channels]
    long = wide.unpivot(keys, list(channels), var, value)
    return long if keep_missing else long.filter(F.col(value).isNotNull())


def to_arrays(wide: DataFrame, channels: Sequence[str], out: str = "channels") -> DataFrame:
    """Channel columns to one array in channel order, for consumers outside Spark."""
    keys = [c for c in wide.columns if c not in channels]
    return wide.select(*keys, F.array(*(F.col(c).cast("double") for c in channels)).alias(out))


def from_arrays(df: DataFrame, channels: Sequence[str], column: str = "channels") -> DataFrame:
    """Inverse of `to_arrays`."""
    keys = [c for c in df.columns if c != column]
    return df.select(*keys, *(F.col(column)[k].alias(c) for k, c in enumerate(channels)))


def conform_frames(df: DataFrame, n_lat: int, n_lon: int, frame: str = "frame", dims: Sequence[str] = ("d0", "d1"),
                   shape: Sequence[str] | None = None) -> DataFrame:
    """Bring frames stored in another shape onto `(i, j)`.

    `dims` are the array positions as stored (two, or three with a leading or trailing
    singleton). `shape` names columns holding the stored extents, as a file header gives
    them; without it the extents are measured per frame. Adds `shape_status`: `as_is`,
    `transposed`, `squeezed` or `bad`. Rows of a bad frame keep their stored positions in
    `d0`/`d1`, have no `i, j`, and are for the caller to null or to regrid.
    """
    if shape is None:
        shape = [f"_n{k}" for k in range(len(dims))]
        extents = df.groupBy(frame).agg(*((F.max(d) + 1).alias(n) for d, n in zip(dims, shape)))
        df, added = join_small(df, extents, frame), list(shape)
    else:
        added = []
    n = [F.col(c) for c in shape]
    d = [F.col(c) for c in dims]

    def matches(*expected: int):
        test = F.lit(True)
        for have, want in zip(n, expected):
            test = test & (have == want)
        return test

    if len(dims) == 2:
        status = F.when(matches(n_lat, n_lon), "as_is").when(matches(n_lon, n_lat), "transposed")
        i = F.when(F.col("shape_status") == "as_is", d[0]).when(F.col("shape_status") == "transposed", d[1])
        j = F.when(F.col("shape_status") == "as_is", d[1]).when(F.col("shape_status") == "transposed", d[0])
    else:
        leading = matches(1, n_lat, n_lon)
        status = F.when(leading | matches(n_lat, n_lon, 1), "squeezed")
        squeezed = F.col("shape_status") == "squeezed"
        i = F.when(squeezed, F.when(leading, d[1]).otherwise(d[0]))
        j = F.when(squeezed, F.when(leading, d[2]).otherwise(d[1]))
    return (
        df.withColumn("shape_status", status.otherwise("bad"))
        .withColumn("i", i.cast("int"))
        .withColumn("j", j.cast("int"))
        .drop(*added)
    )
