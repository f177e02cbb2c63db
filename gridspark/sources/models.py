"""Stored models (E7, E8): coefficients, scaler and feature order as a versioned table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.operators.forecast import LinearModel

#: `part` is `coefficient` (of feature `pos` of a target), `intercept`, `offset` or `divisor` (of a channel's scaler).
SCHEMA = "version int, target string, target_pos int, feature string, pos int, part string, value double"


@dataclass(frozen=True)
class StoredModel:
    version: int
    model: LinearModel
    #: (offset, divisor) per channel; empty if the model works on unscaled data.
    scaler: dict[str, tuple[float, float]]


def scaler_numbers(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """(offset, divisor) per channel of a fitted scaler of either kind; a row per channel is read."""
    if "scale" in scaler.columns:
        return {r["channel"]: (r["mean"], r["scale"]) for r in scaler.collect()}
    return {r["channel"]: (r["min"], r["max"] - r["min"] or 1.0) for r in scaler.collect()}


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions stored at `path`, ascending; none if there is no table yet."""
    try:
        stored = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r["version"] for r in stored.select("version").distinct().collect())


def save_model(spark: SparkSession, path: str, model: LinearModel, scaler: dict[str, tuple[float, float]] | None = None) -> int:
    """Add the model as the next version, in one file of its own; earlier versions stay. Returns the version.

    Files appear when the write commits, so a version is stored whole or not at all.
    """
    version = max(versions(spark, path), default=0) + 1
    at = {t: k for k, t in enumerate(model.targets)}
    rows = [(t, at[t], f, k, "coefficient", float(v)) for t, row in zip(model.targets, model.coefficients) for k, (f, v) in enumerate(zip(model.features, row))]
    rows += [(t, at[t], None, None, "intercept", float(v)) for t, v in zip(model.targets, model.intercepts)]
    rows += [(c, at.get(c), None, None, part, float(v)) for c, pair in (scaler or {}).items() for part, v in zip(("offset", "divisor"), pair)]
    table = spark.createDataFrame(rows, SCHEMA.removeprefix("version int, "))
    table.withColumn("version", F.lit(version)).coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return version


def load_model(spark: SparkSession, path: str, version: int | None = None) -> StoredModel:
    """A stored version, the newest by default. Features and targets come back in the order in which the model knew them."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no such model at {path}: version {version}, stored {known}")
    version = known[-1] if version is None else version
    rows = spark.read.schema(SCHEMA).parquet(path).filter(F.col("version") == version).collect()
    targets = [t for _, t in sorted({(r["target_pos"], r["target"]) for r in rows if r["part"] == "intercept"})]
    features = [f for _, f in sorted({(r["pos"], r["feature"]) for r in rows if r["part"] == "coefficient"})]
    coefficients, intercepts = np.zeros((len(targets), len(features))), np.zeros(len(targets))
    scaler: dict[str, dict[str, float]] = {}
    for r in rows:
        if r["part"] == "coefficient":
            coefficients[r["target_pos"], r["pos"]] = r["value"]
        elif r["part"] == "intercept":
            intercepts[r["target_pos"]] = r["value"]
        else:
            scaler.setdefault(r["target"], {})[r["part"]] = r["value"]
    return StoredModel(version, LinearModel(tuple(features), tuple(targets), coefficients, intercepts), {c: (p["offset"], p["divisor"]) for c, p in scaler.items()})
