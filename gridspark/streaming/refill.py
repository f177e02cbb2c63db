"""Keeping a day-filled cube up to date after later deliveries (A8 with C1).

A filled cube copies days, so a corrected day changes every day copied from it, and a day that
arrives late takes over the copies that an earlier day had supplied. A small table beside the
cube remembers which frame, of which delivery, each day was filled with. The difference between
it and the same table for what is stored now names the days to write again.
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridspark.operators.axes import calendar_length
from gridspark.operators.fill import day_map
from gridspark.operators.small import join_small
from gridspark.streaming.ingest import BATCH, append_days, read_days

MAP = "time date, source_day date, is_original boolean, delivery string, batch long"


def stored_days(spark: SparkSession, ingested: str, schema: T.StructType | str, time: str = "time", delivery: str = "delivery") -> DataFrame:
    """Every ingested day with its greatest delivery and that delivery's last batch. Only folder names and footers are read."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    stored = spark.read.schema(T.StructType([fields[time], fields[delivery], T.StructField(BATCH, T.LongType())])).parquet(ingested)
    newest = F.max(F.struct(F.col(delivery).alias("delivery"), F.col(BATCH).alias("batch")))
    return stored.groupBy(time).agg(newest.alias("v")).select(time, F.col("v.delivery").cast("string").alias("delivery"), "v.batch")


def filled_map(days: DataFrame, start: date, end: date, leading: str = "first", time: str = "time") -> DataFrame:
    """For every calendar day the frame it should hold and that frame's version, a row per day; `days` is what `stored_days` gives."""
    versions = days.withColumnRenamed(time, "source_day")
    mapped = day_map(days, start, end, leading, time)
    return join_small(versions, mapped, "source_day", rows=calendar_length(start, end)).select(F.col(time).alias("time"), "source_day", "is_original", "delivery", "batch")


def _read_map(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(MAP).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stale_days(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """Days whose frame or its version differs from what the cube was filled with: `(time, source_day)`."""
    if before is None:
        return now.select("time", "source_day")
    return now.exceptAll(before.select(*now.columns)).select("time", "source_day")


def refill(spark: SparkSession, ingested: str, filled: str, schema: T.StructType | str, start: date, end: date, leading: str = "first",
           time: str = "time", delivery: str = "delivery") -> list[tuple[date, date]]:
    """Bring the filled cube at `filled` up to date with the days at `ingested`; returns the days written and their sources.

    Only stale days are computed, from the partitions of their source days alone, and only their partitions are
    overwritten. The map is replaced last: after a crash the same days are stale again and are written again. The
    first call, or one after the map was lost, fills every day. Days outside the calendar are left alone.
    The driver holds a row per day of the calendar.
    """
    beside = f"{filled.rstrip('/')}_days"
    now = spark.createDataFrame(filled_map(stored_days(spark, ingested, schema, time, delivery), start, end, leading, time).collect(), MAP)
    stale = [(r["time"], r["source_day"]) for r in stale_days(now, _read_map(spark, beside)).collect()]
    if stale:
        days = spark.createDataFrame(stale, "time date, source_day date").withColumnsRenamed({"time": time})
        sources = sorted({s for _, s in stale})
        # literal days prune the folders that are listed and scanned
        cells = read_days(spark, ingested, schema, time, delivery).filter(F.col(time).isin(sources)).withColumnRenamed(time, "source_day")
        fresh = join_small(cells, days, "source_day", rows=len(stale)).withColumn("is_original", F.col("source_day") == F.col(time))
        append_days(fresh, filled, time)
        now.coalesce(1).write.mode("overwrite").parquet(beside)
    return sorted(stale)


def read_filled(spark: SparkSession, filled: str, schema: T.StructType | str, time: str = "time") -> DataFrame:
    """The filled cube: the columns of `schema`, `source_day` and `is_original`."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*fields, T.StructField("source_day", T.DateType()), T.StructField("is_original", T.BooleanType())])).parquet(filled)
