"""Sliding sequences, splits, samples and batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gridspark.operators.running import global_rank
from gridspark.operators.small import join_small

_HASH_RANGE = 2**31


def n_sequences(n_frames: int, n_in: int, n_out: int) -> int:
    return max(0, n_frames - (n_in + n_out) + 1)


def sequence_starts(spark: SparkSession, n_frames: int, n_in: int = 6, n_out: int = 1) -> DataFrame:
    """All starts 0 .. N-1."""
    return spark.range(n_sequences(n_frames, n_in, n_out)).select(F.col("id").cast("int").alias("seq_start"))


def make_sequences(df: DataFrame, n_in: int = 6, n_out: int = 1, n_frames: int | None = None) -> DataFrame:
    """Every row once per sequence it belongs to, with its step and role (E1). No shuffle."""
    length = n_in + n_out
    frames = F.lit(n_frames) if n_frames is not None else df.agg(F.max("t") + 1).scalar()
    first = F.greatest(F.lit(0), F.col("t") - F.lit(length - 1))
    last = F.least(F.col("t"), frames - F.lit(length)).cast("int")
    return (
        df.filter(first <= last)
        .withColumn("seq_start", F.explode(F.sequence(first, last)))
        .withColumn("step", F.col("t") - F.col("seq_start"))
        .withColumn("role", F.when(F.col("step") < n_in, "input").otherwise("target"))
    )


def sequence_frames(starts: DataFrame, n_in: int = 6, n_out: int = 1) -> DataFrame:
    """The frames of the given starts: start columns plus `step`, `t`, `role`."""
    steps = F.sequence(F.lit(0), F.lit(n_in + n_out - 1))
    return (
        starts.withColumn("step", F.explode(steps))
        .withColumn("t", F.col("seq_start") + F.col("step"))
        .withColumn("role", F.when(F.col("step") < n_in, "input").otherwise("target"))
    )


def gather_sequences(df: DataFrame, starts: DataFrame, n_in: int = 6, n_out: int = 1, n_starts: int | None = None) -> DataFrame:
    """Cells of the given sequences (C9): an equality join on `t` instead of an interval join."""
    return join_small(df, sequence_frames(starts, n_in, n_out), "t", rows=None if n_starts is None else n_starts * (n_in + n_out))


def split_members(df: DataFrame, splits: DataFrame, split: str, start: str = "seq_start", n_starts: int | None = None) -> DataFrame:
    """Rows whose sequence belongs to the split."""
    return join_small(df, splits.filter(F.col("split") == split).select(start), start, "left_semi", rows=n_starts)


def check_starts(starts: DataFrame, n_frames: int, n_in: int = 6, n_out: int = 1) -> DataFrame:
    """The starts unchanged; evaluating one outside 0 .. T-L is an error."""
    s = F.col("seq_start")
    problem = F.concat(F.lit("sequence start out of range: "), s.cast("string"))
    valid = s.between(0, n_frames - n_in - n_out)
    return starts.withColumn("seq_start", F.when(valid, s).otherwise(F.raise_error(problem).cast("int")))


def lag_features(df: DataFrame, values: Sequence[str], n_in: int = 6, cell: Sequence[str] = ("i", "j"),
                 chunk: int = 512, fill: float | None = None) -> DataFrame:
    """Values of the `n_in` previous steps as columns `<value>_lag1 ..` (E1, feature form).

    A lag is the value exactly k steps earlier, NULL or `fill` when that step has none. Each cell's
    series is cut into chunks of `chunk` steps with `n_in` steps of overlap, so a task sorts
    bounded pieces even where one cell holds a large part of the data.
    """
    number = F.floor(F.col("t") / F.lit(chunk)).cast("int")
    pieces = df.withColumn("_chunk", F.explode(F.sequence(number, F.floor((F.col("t") + n_in) / F.lit(chunk)).cast("int"))))
    w = W.partitionBy(*cell, "_chunk").orderBy("t")
    earlier = lambda v, k: F.max(v).over(w.rangeBetween(-k, -k))
    filled = lambda c: c if fill is None else F.coalesce(c, F.lit(float(fill)))
    lagged = {f"{v}_lag{k}": filled(earlier(v, k)) for v in values for k in range(1, n_in + 1)}
    return pieces.withColumns(lagged).filter(number == F.col("_chunk")).drop("_chunk")


def seeded_key(c: Column | str, seed: int) -> Column:
    """Reproducible pseudo-random integer in [0, 2^31) from an identifier."""
    c = F.col(c) if isinstance(c, str) else c
    return F.pmod(F.xxhash64(F.lit(seed), c), F.lit(_HASH_RANGE))


def split_bounds(n: int, train: float, val: float) -> tuple[int, int]:
    """Where the shuffled order is cut."""
    return int(n * train), int(n * (train + val))


def split_sequences(starts: DataFrame, n: int, ratios: tuple[float, float, float] = (0.7, 0.2, 0.1), seed: int = 42,
                    key: Column | None = None, key_range: int = _HASH_RANGE) -> DataFrame:
    """Shuffle the n starts and cut them into train, val and test (F1): `(split, pos, seq_start)`.

    The order is a seeded hash, or `key` with values in [0, key_range). More sequences than a task
    should order are ranked block by block.
    """
    ordered = starts.withColumn("_key", seeded_key("seq_start", seed) if key is None else key)
    ranked = global_rank(ordered, "_key", 0, key_range - 1, ties=["seq_start"], rows=n)
    return cut_order(ranked.select(F.col("rank").alias("pos"), "seq_start"), n, ratios)


def cut_order(order: DataFrame, n: int, ratios: tuple[float, float, float] = (0.7, 0.2, 0.1)) -> DataFrame:
    """Cut a given order `(pos, seq_start)` of n sequences into the three splits."""
    a, b = split_bounds(n, ratios[0], ratios[1])
    pos = F.col("pos")
    return order.select(
        F.when(pos < a, "train").when(pos < b, "val").otherwise("test").alias("split"),
        (pos - F.when(pos < a, F.lit(0)).when(pos < b, F.lit(a)).otherwise(F.lit(b))).cast("int").alias("pos"),
        "seq_start",
    )


def legacy_order(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """The order NumPy's legacy seeded shuffle gives, for splits that must equal existing ones.

    The driver builds the order, one integer per time step, since that shuffle has no other form.
    """
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    return spark.createDataFrame(list(enumerate(order.tolist())), "pos int, seq_start int")


def sample_n(df: DataFrame, n: int = 50, seed: int = 0, id_column: str = "seq_start", key: Column | None = None) -> DataFrame:
    """n rows without replacement in a reproducible random order (F2); a top-n, not a sort."""
    key = seeded_key(id_column, seed) if key is None else key
    return df.orderBy(key, id_column).limit(n)


def batch_id(df: DataFrame, size: int, pos: str = "pos", out: str = "batch") -> DataFrame:
    """Batch number of an ordered set (F3); the last batch may be short."""
    return df.withColumn(out, F.floor(F.col(pos) / F.lit(size)).cast("int"))
