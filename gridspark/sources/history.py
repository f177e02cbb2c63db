"""Training histories and run logs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.operators.running import running

HISTORY = (
    "train_losses array<double>, val_losses array<double>, metrics_history array<map<string,double>>, "
    "current_epoch int, best_metric double"
)

# The layout of a log line and of the messages that matter.
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (\S+) - ([A-Z]+) - (.*)$"
EPOCH = r"^Epoch (\d+) / (\d+) - Train Loss: ([-+.\deEnaif]+)(?: - val_loss: ([-+.\deEnaif]+))?"
BEST = r"New best model saved with metric: \{'val_loss': ([-+.\deEnaif]+)\}"
STOPPED = r"^Early stopping triggered at epoch (\d+)"
COMPLETED = r"^Training completed in ([.\d]+) seconds"


def history_long(histories: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Histories to one row per epoch and metric: `(keys.., epoch, metric, value)`."""
    losses = histories.select(*keys, F.posexplode(F.arrays_zip("train_losses", "val_losses")).alias("pos", "l")).select(
        *keys, (F.col("pos") + 1).alias("epoch"), F.explode(F.array(
            F.struct(F.lit("train_loss").alias("metric"), F.col("l.train_losses").alias("value")),
            F.struct(F.lit("val_loss").alias("metric"), F.col("l.val_losses").alias("value")))).alias("m")).select(*keys, "epoch", "m.*")
    extra = histories.select(*keys, F.posexplode("metrics_history").alias("pos", "m")).select(
        *keys, (F.col("pos") + 1).alias("epoch"), F.explode("m").alias("metric", "value")).filter(F.col("metric") != "val_loss")
    return losses.unionByName(extra).filter(F.col("value").isNotNull())


def read_history(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.schema(HISTORY).json(path, multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    return history_long(files)


def parse_log_lines(lines: DataFrame, text: str = "value", run: str = "run") -> DataFrame:
    """Log lines to events (A13): `(run, ts, level, kind, epoch, epochs, train_loss, val_loss, value)`.

    `kind` is epoch, best, stopped or completed; other lines yield nothing.
    """
    field = lambda k: F.regexp_extract(F.col(text), LINE, k)
    df = lines.select(run, F.try_to_timestamp(F.nullif(field(1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("ts"),
                      field(3).alias("level"), field(4).alias("_m"))
    part = lambda pattern, k: F.regexp_extract("_m", pattern, k)
    kind = (F.when(F.col("_m").rlike(EPOCH), "epoch").when(F.col("_m").rlike(BEST), "best")
            .when(F.col("_m").rlike(STOPPED), "stopped").when(F.col("_m").rlike(COMPLETED), "completed"))
    is_ = lambda k: F.col("kind") == k
    return df.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        run, "ts", "level", "kind",
        F.when(is_("epoch"), part(EPOCH, 1)).when(is_("stopped"), part(STOPPED, 1)).try_cast("int").alias("epoch"),
        part(EPOCH, 2).try_cast("int").alias("epochs"), part(EPOCH, 3).try_cast("double").alias("train_loss"),
        part(EPOCH, 4).try_cast("double").alias("val_loss"),
        F.when(is_("best"), part(BEST, 1)).when(is_("completed"), part(COMPLETED, 1)).try_cast("double").alias("value"))


def epochs_of(events: DataFrame, run: str = "run") -> DataFrame:
    """One row per logged epoch, with the exact best metric where the epoch set a new one.

    A best line belongs to the last epoch line before it. Log order is time order; of two
    lines in the same millisecond the epoch line comes first.
    """
    lines = events.filter(F.col("kind").isin("epoch", "best")).withColumn("_rank", F.when(F.col("kind") == "epoch", 0).otherwise(1))
    seen = running(lines, [run], ["ts", "_rank"], F.floor(F.unix_timestamp("ts") / 3600), {
        "_owner": ("max", F.when(F.col("kind") == "epoch", F.struct("ts", "epoch")))})
    return seen.groupBy(run, F.col("_owner.ts").alias("ts"), F.col("_owner.epoch").alias("epoch")).agg(
        *(F.max(F.when(F.col("kind") == "epoch", F.col(c))).alias(c) for c in ("level", "epochs", "train_loss", "val_loss")),
        F.max(F.when(F.col("kind") == "best", F.col("value"))).alias("best_metric")).filter(F.col("epoch").isNotNull())


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logged epochs of all runs below a path (A13). A run is named by its file's path below `path`; files without an epoch line give no rows."""
    below = re.sub(r"^[a-z0-9]+:/+", "/", path.rstrip("/")) + "/"
    run = F.substring_index("_metadata.file_path", below, -1).alias("run")
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(run, "value")
    return epochs_of(parse_log_lines(lines))
