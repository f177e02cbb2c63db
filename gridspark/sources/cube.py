"""Reading and writing cubes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridspark.functions.missing import nan_to_null
from gridspark.operators.axes import shared_axis
from gridspark.operators.merge import concat_time, merge_cubes
from gridspark.operators.select import to_float32
from gridspark.operators.small import join_small

KEY_FIELDS = {
    "time": T.DateType(), "t": T.IntegerType(), "i": T.IntegerType(), "j": T.IntegerType(),
    "lat": T.DoubleType(), "lon": T.DoubleType(),
}


def cube_schema(variables: Iterable[str], keys: Iterable[str] = tuple(KEY_FIELDS)) -> T.StructType:
    """Explicit schema of a stored cube: double coordinates, single-precision variables."""
    return T.StructType([T.StructField(k, KEY_FIELDS[k]) for k in keys] + [T.StructField(v, T.FloatType()) for v in variables])


def read_cube(spark: SparkSession, path: str, variables: Sequence[str], keys: Sequence[str] = tuple(KEY_FIELDS)) -> DataFrame:
    """Scan the requested variables only (A1), as doubles with NULL for every missing value."""
    df = spark.read.schema(cube_schema(variables, keys)).parquet(path)
    return df.select(*keys, *(nan_to_null(v).alias(v) for v in variables))


def read_cubes(spark: SparkSession, paths: Sequence[str] | str, keys: Sequence[str] | None = None,
               schema: T.StructType | None = None) -> DataFrame:
    """Many files as one cube (A2); the result does not depend on file order.

    Columns may differ between files. With `schema` (see `cube_schema`) columns a file lacks
    read as NULL and no footer is opened beforehand. Without it every path gives the schema of one
    of its files, so columns may differ between paths but not below one. With `keys`, rows of the
    same cell from different files become one row; files that give a variable different values in a
    cell are an error. Files that carry coordinates instead of indices: `combine_by_coords`.
    """
    ordered = [paths] if isinstance(paths, str) else sorted(paths)
    df = spark.read.schema(schema).parquet(*ordered) if schema is not None else concat_time([spark.read.parquet(p) for p in ordered])
    if keys is None:
        return df
    return merge_cubes([df], keys)


def combine_by_coords(df: DataFrame, values: Sequence[str], tolerance: float = 1e-6, time: str | None = "time") -> DataFrame:
    """Rows of many files that carry `lat` and `lon` only as one cube (A2): `(time, i, j, lat, lon, <values>)`.

    The files' coordinates become one ascending axis each, whichever direction a file lists them in; those
    within the tolerance are one position. Files may cover different, overlapping parts. A cell that several
    files hold must have one value per variable, missing ones aside, else it is an error. Rows without a
    coordinate have no cell and are left out.
    """
    lat, lon = (shared_axis(df, c, k, tolerance) for c, k in (("lat", "i"), ("lon", "j")))
    placed = join_small(join_small(df, lat, "lat"), lon, "lon")
    keys = [*([time] if time else []), "i", "j", "_least_lat", "_least_lon"]
    merged = merge_cubes([placed.select(*keys, *values)], keys)
    return merged.withColumnsRenamed({"_least_lat": "lat", "_least_lon": "lon"})


def write_cube(df: DataFrame, path: str, partition: Sequence[str] = ("month",), values: Sequence[str] | None = None,
               mode: str = "overwrite") -> None:
    """Single precision, compressed, partitioned Parquet.

    `month` is derived from `time` when absent. The rebalance hint lets Spark cut a large
    partition over several tasks and join small ones; rows are ordered by time and cell
    inside a file, so crops skip row groups.
    """
    out = to_float32(df, values)
    if "month" in partition and "month" not in out.columns:
        out = out.withColumn("month", F.date_format("time", "yyyy-MM"))
    order = [c for c in (*partition, "time", "t", "i", "j") if c in out.columns]
    (out.hint("rebalance", *(F.col(c) for c in partition)).sortWithinPartitions(*dict.fromkeys(order))
        .write.mode(mode).option("compression", "zstd").partitionBy(*partition).parquet(path))


def write_attributes(spark: SparkSession, attributes: dict[str, str], path: str) -> None:
    """Free-form cube attributes beside the data."""
    spark.createDataFrame([(dict(attributes),)], "attributes map<string,string>").coalesce(1).write.mode("overwrite").json(path)


def read_attributes(spark: SparkSession, path: str) -> dict[str, str]:
    """The attributes written beside a cube: a handful of strings."""
    row = spark.read.schema("attributes map<string,string>").json(path).first()
    return dict(row["attributes"]) if row else {}


def decode_by_attributes(df: DataFrame, variables: Sequence[str], attributes: dict[str, str]) -> DataFrame:
    """Packed variables to values by `<variable>:_FillValue`, `:scale_factor` and `:add_offset` of the attributes."""
    number = lambda v, name, other: float(attributes.get(f"{v}:{name}", other))
    fill = lambda v: F.lit(number(v, "_FillValue", "nan"))
    return df.withColumns({v: F.when(F.col(v) != fill(v), F.col(v) * number(v, "scale_factor", 1) + number(v, "add_offset", 0)) for v in variables})
