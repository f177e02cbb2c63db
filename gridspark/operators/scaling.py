"""Per-channel scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gridspark.functions.missing import fill_missing
from gridspark.operators.sequences import sequence_frames
from gridspark.operators.small import join_small


def fit_scaler(df: DataFrame, starts: DataFrame, channels: Sequence[str], n_in: int = 6, n_out: int = 1,
               kind: str = "standard", cells_per_frame: int | None = None, n_starts: int | None = None) -> DataFrame:
    """Scaler over all cells of the given sequences; missing values count as 0.

    `standard` gives `(channel, mean, scale)` with the population deviation (D3), `minmax`
    gives `(channel, min, max)` (D4). A frame in k of the sequences counts k times: frames
    are summarised once and weighted by k, so no cell is repeated. `cells_per_frame` is the
    grid size of a sparse cube, whose absent rows then count as 0 too. `n_starts` bounds the
    number of starts where it is known, and saves measuring it.
    """
    if kind not in ("standard", "minmax"):
        raise ValueError(f"unknown scaler: {kind}")
    weights = sequence_frames(starts, n_in, n_out).groupBy("t").agg(F.count(F.lit(1)).alias("_k"))
    filled = fill_missing(df.select("t", *channels), channels)
    per_frame = join_small(filled, weights.select("t"), "t", "left_semi", rows=None if n_starts is None else n_starts * (n_in + n_out)).groupBy("t").agg(
        F.count(F.lit(1)).alias("_n"),
        *(F.struct(F.avg(c).alias("mean"), F.var_pop(c).alias("var"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
          for c in channels),
    )
    frames = weights.join(per_frame, "t", "left") if cells_per_frame else weights.join(per_frame, "t")
    stats = frames.select(F.col("_k").alias("k"), F.coalesce("_n", F.lit(0)).alias("n"), F.explode(F.array(*(
        F.struct(F.lit(c).alias("channel"), F.col(c).alias("s")) for c in channels))).alias("e")).select("k", "n", "e.channel", "e.s.*")
    if cells_per_frame:
        stats = _with_zero_cells(stats, cells_per_frame)
    if kind == "minmax":
        return stats.groupBy("channel").agg(F.min("lo").alias("min"), F.max("hi").alias("max"))
    stats = stats.withColumn("w", F.col("k") * F.col("n"))
    whole = W.partitionBy("channel")
    centred = stats.withColumn("mu", F.sum(F.col("w") * F.col("mean")).over(whole) / F.sum("w").over(whole))
    spread = F.col("var") + (F.col("mean") - F.col("mu")) * (F.col("mean") - F.col("mu"))
    return centred.groupBy("channel").agg(
        F.max("mu").alias("mean"), F.sqrt(F.sum(F.col("w") * spread) / F.sum("w")).alias("scale")
    ).withColumn("scale", F.when(F.col("scale") == 0.0, F.lit(1.0)).otherwise(F.col("scale")))


def _with_zero_cells(stats: DataFrame, cells: int) -> DataFrame:
    """Frame statistics after adding the grid cells that have no row, all of them 0."""
    n, total = F.col("n"), F.lit(float(cells))
    present, absent = n / total, (total - n) / total
    mean = F.coalesce("mean", F.lit(0.0))
    none_absent = n >= cells
    return stats.select(
        "k", F.greatest(n, F.lit(cells)).alias("n"), "channel",
        F.when(none_absent, F.col("mean")).otherwise(present * mean).alias("mean"),
        F.when(none_absent, F.col("var")).otherwise(present * F.coalesce("var", F.lit(0.0)) + present * absent * mean * mean).alias("var"),
        F.when(none_absent, F.col("lo")).otherwise(F.least("lo", F.lit(0.0))).alias("lo"),
        F.when(none_absent, F.col("hi")).otherwise(F.greatest("hi", F.lit(0.0))).alias("hi"),
    )


def _parameters(scaler: DataFrame, channels: Sequence[str], first: str, second: str) -> Column:
    """The scaler's few rows as one struct, `<channel>` -> (first, second)."""
    picked = [
        F.struct(*(F.max(F.when(F.col("channel") == c, F.col(p))).alias(p) for p in (first, second))).alias(c)
        for c in channels
    ]
    return scaler.agg(F.struct(*picked).alias("scaler")).scalar()


_SCALER = "_scaler"


def _with_scaler(df: DataFrame, scaler: DataFrame, channels: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    """The parameters as one helper column, and offset and divisor per channel for either kind of scaler."""
    s = F.col(_SCALER)
    if "scale" in scaler.columns:
        return df.withColumn(_SCALER, _parameters(scaler, channels, "mean", "scale")), {c: (s[c]["mean"], s[c]["scale"]) for c in channels}
    width = {c: s[c]["max"] - s[c]["min"] for c in channels}
    bounds = {c: (s[c]["min"], F.when(width[c] == 0.0, F.lit(1.0)).otherwise(width[c])) for c in channels}
    return df.withColumn(_SCALER, _parameters(scaler, channels, "min", "max")), bounds


def fixed(scaler: DataFrame) -> DataFrame:
    """The scaler fitted once, its row per channel as constants, for plans that use it more than once."""
    return scaler.sparkSession.createDataFrame(scaler.collect(), scaler.schema)


def transform(df: DataFrame, scaler: DataFrame | None, channels: Sequence[str]) -> DataFrame:
    """Scaled channels (E2); without a scaler the data is unchanged."""
    if scaler is None:
        return df
    df, bounds = _with_scaler(df, scaler, channels)
    return df.withColumns({c: (F.col(c) - a) / b for c, (a, b) in bounds.items()}).drop(_SCALER)


def inverse_transform(df: DataFrame, scaler: DataFrame | None, channels: Sequence[str]) -> DataFrame:
    """Back to physical units (E3), each channel with its own parameters."""
    if scaler is None:
        return df
    df, bounds = _with_scaler(df, scaler, channels)
    return df.withColumns({c: F.col(c) * b + a for c, (a, b) in bounds.items()}).drop(_SCALER)


def save_scaler(scaler: DataFrame, path: str) -> None:
    scaler.coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _squash(x: Column, mean: Column, std: Column, clip: float, span: float) -> Column:
    safe = F.when(std < 1e-6, F.lit(1.0)).otherwise(std)
    z = (x - mean) / safe
    return F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)) * F.lit(span / clip))


def zscore_clip(df: DataFrame, columns: Sequence[str], clip: float = 3.0, span: float = math.pi) -> DataFrame:
    """Standardise over all rows (sample deviation), clip, rescale to [-span, span]."""
    stats = df.agg(F.struct(*(F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in columns)).alias("s")).scalar()
    s = F.col(_SCALER)
    return df.withColumn(_SCALER, stats).withColumns(
        {c: _squash(F.col(c), s[c]["mean"], s[c]["std"], clip, span) for c in columns}).drop(_SCALER)


def zscore_clip_by(df: DataFrame, feature: str, value: str, clip: float = 3.0, span: float = math.pi) -> DataFrame:
    """The same for one row per feature value: `feature` names the feature."""
    stats = df.groupBy(feature).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    return join_small(df, stats, feature).withColumn(
        value, _squash(F.col(value), F.col("_mean"), F.col("_std"), clip, span)).drop("_mean", "_std")
