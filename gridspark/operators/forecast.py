"""Scores, the lag model and the rollout."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridspark.operators.running import running


def squared_error(pred: str = "pred", target: str = "target") -> Column:
    return F.pow(F.col(pred) - F.col(target), F.lit(2.0))


def score_join(pred: DataFrame, target: DataFrame, keys: Sequence[str] = ("sample", "step", "channel", "i", "j"),
               value: str = "value") -> DataFrame:
    """Predictions beside their targets.

    The keys identify a cell, so they spread evenly whatever one sample or channel holds.
    """
    return pred.withColumnRenamed(value, "pred").join(target.withColumnRenamed(value, "target"), list(keys))


def score(df: DataFrame, metrics: Mapping[str, Column] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """MSE over all cells (D13) plus any user metrics given as aggregate columns."""
    extra = [m.alias(name) for name, m in (metrics or {}).items()]
    return df.groupBy(*by).agg(F.avg(squared_error()).alias("mse"), *extra)


def batch_scores(df: DataFrame, batch: str = "batch", sample: str = "sample", by: Sequence[str] = ()) -> DataFrame:
    """MSE and number of samples of every batch. Samples are summarised before batches."""
    per_sample = df.groupBy(*by, batch, sample).agg(F.sum(squared_error()).alias("se"), F.count(squared_error()).alias("n"))
    return per_sample.groupBy(*by, batch).agg(
        F.try_divide(F.sum("se"), F.sum("n").cast("double")).alias("mse"), F.count(F.lit(1)).alias("n_samples"))


def batch_mse(batches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of the batch values (D13 b)."""
    return batches.groupBy(*by).agg(F.avg("mse").alias("mse"))


def sample_mse(batches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Batch values weighted by their samples (D13 a)."""
    return batches.groupBy(*by).agg((F.sum(F.col("mse") * F.col("n_samples")) / F.sum("n_samples")).alias("mse"))


def running_mse(batches: DataFrame, batch: str = "batch", block: int = 4096, n_batches: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Both running values after each batch (D13 c). A known number of batches saves or shortens the carrying between blocks."""
    done = running(batches, by, [batch], F.floor(F.col(batch) / F.lit(block)), {
        "_se": ("sum", F.col("mse") * F.col("n_samples")), "_samples": ("sum", F.col("n_samples")),
        "_sum": ("sum", F.col("mse")), "_batches": ("sum", F.lit(1).cast("long"))}, blocks=None if n_batches is None else n_batches // block + 1)
    return done.select(*by, batch, (F.col("_se") / F.col("_samples")).alias("running_by_sample"),
                       (F.col("_sum") / F.col("_batches")).alias("running_by_batch"))


def lag_names(channels: Sequence[str], n_in: int) -> list[str]:
    return [f"{c}_lag{k}" for c in channels for k in range(1, n_in + 1)]


@dataclass(frozen=True)
class LinearModel:
    """Least-squares predictors of several targets from the same features."""

    features: tuple[str, ...]
    targets: tuple[str, ...]
    coefficients: np.ndarray
    intercepts: np.ndarray

    def predictor(self) -> Callable[[np.ndarray], np.ndarray]:
        """Rows of feature values to rows of predictions; carries arrays only, so tasks need no library."""
        weights, intercepts = self.coefficients.T, self.intercepts
        return lambda x: x @ weights + intercepts

    def expression(self, target: str) -> Column:
        """The prediction of one target as a column expression; unused features are left out."""
        r = self.targets.index(target)
        total = F.lit(float(self.intercepts[r]))
        for c, name in zip(self.coefficients[r], self.features):
            if c != 0.0:
                total = total + F.lit(float(c)) * F.col(name)
        return total

    def predict(self, df: DataFrame, suffix: str = "_pred") -> DataFrame:
        return df.withColumns({t + suffix: self.expression(t) for t in self.targets})

    def table(self, spark: SparkSession) -> DataFrame:
        """The coefficients as rows, `(target, feature, value)`."""
        rows = [(t, f, float(v)) for t, row in zip(self.targets, self.coefficients) for f, v in zip(self.features, row)]
        rows += [(t, "intercept", float(v)) for t, v in zip(self.targets, self.intercepts)]
        return spark.createDataFrame(rows, "target string, feature string, value double")


def fit_linear(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> LinearModel:
    """Least squares for all targets together (E8), in two passes over the rows.

    The first finds the means, so that sums of products of large values lose no digits. In
    the second every task reduces its batches to one matrix of centred sums of products,
    Spark adds the matrices, and the driver solves a system with a row per feature, whatever
    the row count. Rows with a missing value are left out. Constant features get no weight.
    """
    names = [*features, *targets]
    size = len(names) + 1
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    middle = df.agg(*(F.avg(finite(F.col(c).cast("double"))).alias(f"m{k}") for k, c in enumerate(names))).first()
    centre = np.array([x or 0.0 for x in middle])

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            x = x[np.isfinite(x).all(axis=1)] - centre
            x = np.column_stack([np.ones(len(x)), x])
            total += x.T @ x
        row, col = np.indices((size, size))
        yield pd.DataFrame({"row": row.ravel(), "col": col.ravel(), "value": total.ravel()})

    sums = df.select(*(F.col(c).cast("double").alias(c) for c in names)).mapInPandas(moments, "row int, col int, value double")
    m = np.zeros((size, size))
    for r in sums.groupBy("row", "col").agg(F.sum("value").alias("value")).collect():
        m[r["row"], r["col"]] = r["value"]
    if m[0, 0] == 0:
        raise ValueError("no complete rows to fit")
    mean = m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] / m[0, 0] - np.outer(mean, mean)
    p = len(features)
    std = np.sqrt(np.maximum(np.diag(cov)[:p], 0))
    used = std > 1e-12 * np.maximum(1.0, np.abs(mean[:p] + centre[:p]))
    coef = np.zeros((len(targets), p))
    if used.any():
        unit = std[used]
        beta = np.linalg.lstsq(cov[:p, :p][np.ix_(used, used)] / np.outer(unit, unit), cov[:p, p:][used] / unit[:, None], rcond=None)[0]
        coef[:, used] = (beta / unit[:, None]).T
    return LinearModel(tuple(features), tuple(targets), coef, (mean + centre)[p:] - coef @ (mean + centre)[:p])


def fit_lag_model(df: DataFrame, channels: Sequence[str], n_in: int = 6) -> LinearModel:
    """Each channel from the last `n_in` steps of all channels; `df` comes from `lag_features`."""
    return fit_linear(df, lag_names(channels, n_in), channels)


def persistence(channels: Sequence[str], n_in: int = 6) -> LinearModel:
    """Tomorrow equals today: the baseline, in the form of a model."""
    features = lag_names(channels, n_in)
    coef = np.zeros((len(channels), len(features)))
    for r, c in enumerate(channels):
        coef[r, features.index(f"{c}_lag1")] = 1.0
    return LinearModel(tuple(features), tuple(channels), coef, np.zeros(len(channels)))


def last_lags(df: DataFrame, channels: Sequence[str], n_in: int, end: int, cell: Sequence[str] = ("i", "j"),
              cells: DataFrame | None = None) -> DataFrame:
    """Per cell the `n_in` steps before step `end` as lag columns: where a rollout starts.

    `cells` is the grid's table of keys: its cells appear even where no recent step has a row.
    """
    recent = df.filter((F.col("t") < end) & (F.col("t") >= end - n_in)).select(*cell, "t", *channels)
    if cells is not None:
        recent = recent.unionByName(cells.select(*cell), allowMissingColumns=True)
    return recent.groupBy(*cell).agg(*(
        F.max(F.when(F.col("t") == end - k, F.col(c))).alias(f"{c}_lag{k}") for c in channels for k in range(1, n_in + 1)))


def rollout(state: DataFrame, model: LinearModel, n_in: int = 6, horizon: int = 10, cell: Sequence[str] = ("i", "j"), inputs: bool = False) -> DataFrame:
    """Predict, append, slide (E7): one row per cell and step 1 .. horizon; with `inputs` also the steps 1 - n_in .. 0 it starts from.

    A cell needs only its own lags, so each Arrow batch is carried through all steps on its
    own, without a shuffle. Missing inputs are 0. `model` may be anything with `features`
    (`<channel>_lag<k>`), `targets` and `predictor()`.
    """
    channels = list(model.targets)
    lags = lag_names(channels, n_in)
    use = [lags.index(f) for f in model.features]
    apply = model.predictor()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.nan_to_num(batch[lags].to_numpy(dtype=float)).reshape(len(batch), len(channels), n_in)
            for step in range(1 - n_in, 1) if inputs else ():
                yield batch[list(cell)].assign(step=step, **{c: x[:, k, -step] for k, c in enumerate(channels)})
            for step in range(1, horizon + 1):
                y = apply(x.reshape(len(batch), -1)[:, use])
                x = np.concatenate([y[:, :, None], x[:, :, :-1]], axis=2)
                yield batch[list(cell)].assign(step=step, **{c: y[:, k] for k, c in enumerate(channels)})

    cells = T.StructType([state.schema[c] for c in cell])
    fields = T.StructType([*cells.fields, T.StructField("step", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in channels)])
    return state.select(*cell, *(F.col(c).cast("double").alias(c) for c in lags)).mapInPandas(run, fields)


def rollout_scaled(state: DataFrame, model: LinearModel, scaler: Mapping[str, tuple[float, float]], n_in: int = 6, horizon: int = 10,
                   cell: Sequence[str] = ("i", "j")) -> DataFrame:
    """A rollout of a model of scaled channels, from and to physical units: steps 1 - n_in .. 0 are the input frames, 1 .. horizon the forecast.

    `state` holds physical lags (see `last_lags`), missing ones count as 0 before scaling. `scaler` gives
    (offset, divisor) per channel, as `models.load_model` does.
    """
    channels = list(model.targets)
    scaled = state.withColumns({f"{c}_lag{k}": (F.coalesce(f"{c}_lag{k}", F.lit(0.0)) - F.lit(scaler[c][0])) / F.lit(scaler[c][1])
                                for c in channels for k in range(1, n_in + 1)})
    return rollout(scaled, model, n_in, horizon, cell, inputs=True).withColumns({c: F.col(c) * F.lit(scaler[c][1]) + F.lit(scaler[c][0]) for c in channels})
