"""Daily files without a time dimension: a frame per file, its day in the path."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridspark.operators.fill import fill_days
from gridspark.operators.merge import concat_time, one_value
from gridspark.operators.regrid import resize_frames
from gridspark.operators.reshape import conform_frames


def read_daily(spark: SparkSession, path: str, schema: T.StructType | str, day: Callable[[Column], Column], time: str = "time",
               tolerant: bool = False) -> DataFrame:
    """Rows of every file below `path`, each with the day that `day` reads from the file's path.

    Files without a day in their path are no frames and are left out. With `tolerant`, files that cannot be
    read give no rows instead of failing the job; `unread_days` finds them.
    """
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
    rows = (reader.option("ignoreCorruptFiles", "true") if tolerant else reader).parquet(path)
    return rows.withColumn(time, day(F.col("_metadata.file_path"))).filter(F.col(time).isNotNull())


def file_status(spark: SparkSession, path: str, schema: T.StructType | str, day: Callable[[Column], Column], pattern: str = "*.parquet",
                time: str = "time") -> DataFrame:
    """What became of every file listed below `path` (B16): `(path, time, n_rows, status)`.

    `status` is `read`, `undated` (no day in its path, so no frame) or `unread`: the listing knows the file but a
    tolerant scan got no rows out of it, since it is cut short, is no Parquet, or is empty. The scan reads no column.
    """
    scanned = spark.read.schema(schema).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("pathGlobFilter", pattern).parquet(path)
    # the listing that the driver plans scans with; unlike a scan of it, it knows files without a byte
    listed = spark.createDataFrame([(p,) for p in scanned.inputFiles()], "path string")
    # a count per file is all that is shuffled
    found = scanned.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))
    plain = lambda df: df.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))
    both = plain(listed).join(plain(found), "path", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).withColumn(time, day(F.col("path")))
    return both.select("path", time, "n_rows", F.when(F.col(time).isNull(), "undated").when(F.col("n_rows") > 0, "read").otherwise("unread").alias("status"))


def unread_days(status: DataFrame, time: str = "time") -> DataFrame:
    """Days of which a file is listed but none could be read: at most a row per day."""
    return status.filter(F.col(time).isNotNull()).groupBy(time).agg(F.count_if(F.col("status") == "read").alias("n_read")).filter("n_read = 0").select(time)


def folder_name(path: Column) -> Column:
    """The name of the folder that holds a file: what a cluster writer leaves for one daily file."""
    return F.element_at(F.split(path, "/"), -2)


def daily_cube(frames: DataFrame, values: Sequence[str], start: date, end: date, n_lat: int, n_lon: int, dims: Sequence[str],
               shape: Sequence[str], time: str = "time", resized: Sequence[str] = (), unread: DataFrame | None = None) -> DataFrame:
    """Decoded daily frames to one dense cube with a frame for every day, `(time, t, i, j, <values>, source_day, is_original)`.

    Frames stored transposed or with a singleton are turned. Of a frame of any other shape the variables in
    `resized` are interpolated to the output grid (two stored dimensions), all others are missing there. Days in
    `unread` (see `unread_days`) have a frame without values: it counts as their frame and as a source. Days
    without a file take the latest frame before them.
    """
    turned = conform_frames(frames, n_lat, n_lon, time, dims, shape)
    t = F.datediff(time, F.lit(start)).alias("t")
    pieces = [turned.filter("shape_status <> 'bad'").select(t, "i", "j", *values)]
    if resized:
        bad = turned.filter("shape_status = 'bad'")
        pieces.append(resize_frames(bad, resized, n_lat, n_lon, dims, shape, [time]).select(t, "i", "j", *resized))
    # a row per day that has a file, early and late ones included: they are sources too
    days = frames.select(t) if unread is None else frames.select(t).union(unread.select(t))
    rows = days.distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_lat - 1))))
    pieces.append(rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_lon - 1)))))
    stacked = concat_time(pieces)
    dense = stacked.groupBy("t", "i", "j").agg(*(one_value(stacked, v).alias(v) for v in values))
    dated = dense.withColumn(time, F.date_add(F.lit(start), F.col("t"))).select(time, "t", "i", "j", *values)
    return fill_days(dated, start, end, time=time)
