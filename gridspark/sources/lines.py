"""Numbered lines of large text files, read in pieces."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gridspark.operators.small import join_small


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """`(path, line, value)` of every file below `path`, lines counted from 0, whatever pieces Spark cuts a file into.

    A piece starts at a byte, not at a known line. Its lines keep their order inside it, so a line's number is its
    place in the piece plus the lines of the pieces before it in the file: a table with a row per piece. Both
    scans plan the same pieces, and lines are not shuffled while that table is small.
    """
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("at"), "value")
    pieces = raw.groupBy("path", "piece").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("path").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = pieces.select(F.col("path").alias("_path"), F.col("piece").alias("_piece"), (before - F.col("_first")).alias("_shift"))
    same = reduce(and_, (F.col(c) == F.col(f"_{c}") for c in ("path", "piece")))
    return join_small(raw, shifts, same).select("path", (F.col("at") + F.col("_shift")).alias("line"), "value")
