"""File manifests: which file serves which day."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.functions.dates import base_name
from gridspark.functions.names import in_product
from gridspark.operators.small import join_small


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths, names, sizes and modification times below a folder, without reading contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(
        "path", base_name("path").alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def of_product(files: DataFrame, prefix: str, suffix: str, name: str = "name") -> DataFrame:
    """Files of one product, by prefix and suffix."""
    return files.filter(in_product(name, prefix, suffix))


def one_file_per_day(manifest: DataFrame, keep: str = "first", date: str = "date", path: str = "path") -> DataFrame:
    """One file per day (A6), the first or last by path; files without a date are ignored."""
    pick = {"first": F.min, "last": F.max}[keep]
    return manifest.filter(F.col(date).isNotNull()).groupBy(date).agg(pick(path).alias(path))


def pending(wanted: DataFrame, existing: DataFrame, date: str = "date") -> DataFrame:
    """Days that have no file yet."""
    return join_small(wanted, existing.select(date).distinct(), date, "left_anti")


def validate_files(files: DataFrame, variable: str, path: str = "path", max_open: int = 16) -> DataFrame:
    """Whether each Parquet file opens and holds the variable (D20): `(path, readable, has_variable)`.

    Tasks read footers only, `max_open` files at a time. A file that is no Parquet is unreadable; any other failure, a missing
    file or a store without access, is raised.
    """
    import pyarrow as pa
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    def footer(p: str) -> tuple[str, bool, bool]:
        try:
            uri = p.replace("s3a://", "s3://", 1) if "://" in p else p.replace("file:", "file://", 1)
            fs, inner = pafs.FileSystem.from_uri(uri)
            return p, True, variable in pq.read_schema(inner, filesystem=fs).names
        except pa.ArrowInvalid:
            return p, False, False

    def inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # opening a file is waiting for its store: a task keeps a bounded number of them open at a time
        with ThreadPoolExecutor(max_open) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(footer, batch[path])), columns=["path", "readable", "has_variable"])

    return files.select(path).mapInPandas(inspect, "path string, readable boolean, has_variable boolean")


def validity_rate(checked: DataFrame, expected: int = 365) -> DataFrame:
    """Valid files and their share of the expected number (D20), one row."""
    good = F.count_if(F.col("readable") & F.col("has_variable"))
    return checked.agg(good.alias("n_valid"), F.count(F.lit(1)).alias("n_files")).withColumn("expected", F.lit(expected)).withColumn(
        "percent", F.col("n_valid") * F.lit(100.0) / F.lit(expected))
