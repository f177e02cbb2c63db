"""Idempotent daily ingestion (A8): a later delivery of a day replaces it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: The micro-batch that stored a file.
BATCH = "_batch"


def append_days(df: DataFrame, dst: str, time: str = "time", parts: Sequence[str] = ()) -> None:
    """Write by day (and `parts`); what is already there of the same day and parts is replaced, all else is left alone."""
    days = df.hint("rebalance", F.col(time), *(F.col(p) for p in parts))
    (days.sortWithinPartitions(*(c for c in (time, *parts, "i", "j") if c in df.columns))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        .partitionBy(time, *parts).parquet(dst))


def ingest_incremental(spark: SparkSession, src: str, dst: str, checkpoint: str, schema: T.StructType | str,
                       time: str = "time", delivery: str = "delivery", max_files: int | None = None) -> None:
    """Take in every file of `src` not yet seen, then return.

    A day may lie in any number of files, and they may arrive in any number of batches. `delivery`, a
    column of `schema` and of the files or a folder of `src` (`delivery=3/..`), says what belongs
    together: all rows of a day's greatest delivery count, and `read_days` gives them. Stored days are
    cut by delivery and batch, so a batch repeated after a crash replaces only what it wrote itself.
    The stream remembers files in `checkpoint`. Day fills belong after ingestion: a late file changes
    days copied from earlier ones.
    """
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def take(batch: DataFrame, number: int) -> None:
        append_days(batch.withColumn(BATCH, F.lit(number).cast("long")), dst, time, (delivery, BATCH))

    query = reader.parquet(src).writeStream.option("checkpointLocation", checkpoint).foreachBatch(take).trigger(availableNow=True).start()
    query.awaitTermination()


def read_days(spark: SparkSession, dst: str, schema: T.StructType | str, time: str = "time", delivery: str = "delivery") -> DataFrame:
    """Every row of each day's greatest delivery, with the columns of `schema`."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    stored = spark.read.schema(T.StructType([*fields, T.StructField(BATCH, T.LongType())])).parquet(dst).drop(BATCH)
    newest = stored.groupBy(time).agg(F.max(delivery).alias(delivery))
    return stored.join(newest, [time, delivery], "left_semi").select(*fields.names)
