"""Training histories: best so far, patience, early stop (E5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridspark.operators.running import running


def early_stopping(df: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "metric", patience: int = 20,
                   block: int = 1024) -> DataFrame:
    """Per epoch whether it is the best so far, epochs since the best, and whether patience is used up.

    Best means strictly below everything before; a missing or NaN metric is never best. The
    best so far is the smallest (metric, epoch) pair, so of equal metrics the first counts.
    Every run stands alone; a long run is handled block by block.
    """
    m, e = F.col(metric), F.col(epoch)
    pair = F.when(m < F.lit(float("inf")), F.struct(m.alias("metric"), e.alias("epoch")))
    seen = running(df, [run], [epoch], F.floor(e / F.lit(block)), {"_best": ("min", pair), "_first": ("min", e)})
    return seen.select(
        *df.columns, F.coalesce(F.col("_best.epoch") == e, F.lit(False)).alias("is_best"),
        (e - F.coalesce(F.col("_best.epoch"), F.col("_first") - 1)).alias("epochs_since_best"),
    ).withColumn("should_stop", F.col("epochs_since_best") >= patience)


def stop_summary(marked: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "metric") -> DataFrame:
    """Per run: first epoch at which training would stop, and the best epoch and metric up to then."""
    e = F.col(epoch)
    at = F.struct(e.alias("epoch"), (e - F.col("epochs_since_best")).alias("best"))
    ends = marked.groupBy(run).agg(F.min(F.when(F.col("should_stop"), at)).alias("stop"), F.max(at).alias("last"))
    best = ends.select(run, F.col("stop.epoch").alias("stop_epoch"), F.coalesce("stop.best", "last.best").alias("best_epoch"))
    found = marked.filter("is_best").select(run, e.alias("best_epoch"), F.col(metric).alias("best_metric"))
    return best.join(found, [run, "best_epoch"], "left").select(
        run, "stop_epoch", "best_metric", F.when(F.col("best_metric").isNotNull(), F.col("best_epoch")).alias("best_epoch"))
