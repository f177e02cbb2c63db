"""Prediction sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FIELDS = ("sample", "channel", "i", "j", "value")


def last_predictions(df: DataFrame) -> DataFrame:
    """Rows `(sample, channel, i, j, value)`: of each sample the last step, where there are steps."""
    missing = [c for c in FIELDS if c not in df.columns]
    if missing:
        raise ValueError(f"predictions need the columns {FIELDS}, missing: {missing}")
    if "step" in df.columns:
        df = df.join(df.groupBy("sample").agg(F.max("step").alias("step")), ["sample", "step"], "left_semi")
    return df.select(*FIELDS)


def write_predictions(df: DataFrame, path: str) -> None:
    last_predictions(df).withColumn("value", F.col("value").cast("float")).write.mode("overwrite").option("compression", "zstd").parquet(path)
