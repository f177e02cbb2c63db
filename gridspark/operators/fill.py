"""Completing the calendar: day fills and monthly fields."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window as W, functions as F

from gridspark.operators.axes import calendar, calendar_length
from gridspark.operators.small import join_small


def day_map(frames: DataFrame, start: date, end: date, leading: str = "first", time: str = "time") -> DataFrame:
    """For every calendar day the day whose frame it takes: `(time, source_day, is_original)`.

    The day itself if a frame exists, else the latest earlier one; days before the first
    frame take the first (`leading="first"`) or are an error (`leading="error"`). Frames
    outside the calendar count as sources. Days beyond either end are folded into one row
    each before anything is ordered, so the window sees at most the calendar plus two rows.
    """
    if leading not in ("first", "error"):
        raise ValueError(f"unknown leading rule: {leading}")
    day = F.col(time)
    folded = (
        F.when(day < F.lit(start), F.lit(start - timedelta(days=1)))
        .when(day > F.lit(end), F.lit(end + timedelta(days=1)))
        .otherwise(day)
    )
    known = frames.filter(day.isNotNull()).groupBy(folded.alias("day")).agg(F.max(day).alias("latest"), F.min(day).alias("earliest"))
    days = calendar(frames.sparkSession, start, end).select(F.col("time").alias("day"))
    stacked = (
        days.unionByName(known, allowMissingColumns=True)
        .groupBy("day")
        .agg(F.max("latest").alias("latest"), F.min("earliest").alias("earliest"))
    )
    so_far = W.orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.orderBy("day").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = F.max("latest").over(so_far)
    if leading == "first":
        source = F.coalesce(found, F.min("earliest").over(everything))
    else:
        source = F.coalesce(found, F.raise_error(F.concat(F.lit("no frame on or before "), F.col("day").cast("string"))).cast("date"))
    return (
        stacked.select("day", source.alias("source_day"))
        .filter(F.col("day").between(F.lit(start), F.lit(end)))
        .select(F.col("day").alias("time"), "source_day", (F.col("source_day") == F.col("day")).alias("is_original"))
    )


def fill_days(frames: DataFrame, start: date, end: date, leading: str = "first", time: str = "time") -> DataFrame:
    """One frame for every calendar day (C1, C2), with its provenance (C11).

    The unit is the frame: a cell missing inside an existing frame stays missing. The cells
    are joined with the broadcast day map and never shuffled or sorted.
    """
    days = day_map(frames, start, end, leading, time).withColumnRenamed("time", time)
    cells = frames.withColumnRenamed(time, "source_day")
    filled = join_small(cells, days, "source_day", rows=calendar_length(start, end))
    if "t" in frames.columns:
        filled = filled.withColumn("t", F.datediff(time, F.lit(start)))
    return filled.select(*frames.columns, "source_day", "is_original")


def provenance_summary(days: DataFrame) -> DataFrame:
    """How many days are original and how many copied (D8), from `day_map`."""
    return days.groupBy("is_original").agg(F.count(F.lit(1)).alias("n_days")).withColumn(
        "percent", F.col("n_days") * F.lit(100.0) / days.agg(F.count(F.lit(1))).scalar()
    )


def null_frames(cells: DataFrame, days: DataFrame, values: Sequence[str], time: str = "time") -> DataFrame:
    """All-missing frames on the output grid for the given days.

    `days` is a day table, at most one row per calendar day; it travels as one array.
    """
    wanted = days.agg(F.collect_set(F.col(time))).scalar()
    return (
        cells.withColumn("_days", wanted)
        .withColumn(time, F.explode("_days"))
        .drop("_days")
        .withColumns({v: F.lit(None).cast("double") for v in values})
    )


def monthly_to_daily(monthly: DataFrame, start: date, end: date, cells: DataFrame | None = None,
                     month: str = "month", time: str = "time") -> DataFrame:
    """Every day gets the frame of its month (C3); a month without a frame is missing.

    A frame may be dated on any day of its month; of several in a month the first counts.
    The month expands into its own days in place, so no calendar is joined. With `cells`
    (the grid's key columns) the result is dense: absent months and cells are NULL rows.
    They are added while the data is still monthly, thirty times smaller.
    """
    values = [c for c in monthly.columns if c != month]
    own = F.trunc(F.col(month), "MM")
    inside = monthly.filter(own.between(F.trunc(F.lit(start), "MM"), F.lit(end)))
    # a row per calendar month
    firsts = inside.groupBy(own.alias("_month")).agg(F.min(month).alias(month)).select(month)
    monthly = join_small(inside, firsts, month, "left_semi", rows=calendar_length(start, end)).withColumn(month, own)
    if cells is not None:
        keys = cells.columns
        values = [c for c in values if c not in keys]
        months = F.sequence(F.trunc(F.lit(start), "MM"), F.trunc(F.lit(end), "MM"), F.expr("interval 1 month"))
        full = cells.withColumn(month, F.explode(months))
        monthly = (
            full.unionByName(monthly.select(month, *keys, *values), allowMissingColumns=True)
            .groupBy(month, *keys)
            .agg(*(F.max(v).alias(v) for v in values))
        )
        values = [*keys, *values]
    first = F.greatest(F.col(month), F.lit(start))
    last = F.least(F.last_day(month), F.lit(end))
    return (
        monthly.filter(first <= last)
        .withColumn(time, F.explode(F.sequence(first, last, F.expr("interval 1 day"))))
        .select(time, *values)
    )
