"""Metrics as user functions over complete outputs.

A metric that no aggregate column states is four functions on a state of bounded size. Every task folds its
Arrow batches into one state per group, states are merged in two rounds, and the last round finishes them; neither
the driver nor one task ever holds predictions.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gridspark.session import share_library

#: Groups that a task holds before it passes their states on, and parts in which a group's states are merged first.
HELD, PARTS = 10_000, 64


class Metric(Protocol):
    """States must pickle; `merge` must not care about order."""

    def start(self) -> Any: ...

    def add(self, state: Any, pred: np.ndarray, target: np.ndarray) -> Any: ...

    def merge(self, a: Any, b: Any) -> Any: ...

    def finish(self, state: Any) -> float | None: ...


class QuantileError:
    """Quantile of the absolute error, as the upper edge of its cell on a grid of `width`; the last cell is open."""

    def __init__(self, share: float, width: float, cells: int = 65_536):
        self.share, self.width, self.cells = share, width, cells

    def start(self) -> dict[int, int]:
        return {}

    def add(self, state: dict[int, int], pred: np.ndarray, target: np.ndarray) -> dict[int, int]:
        cell, n = np.unique(np.minimum(np.floor(np.abs(pred - target) / self.width), self.cells - 1).astype(int), return_counts=True)
        return self.merge(state, dict(zip(cell.tolist(), n.tolist())))

    def merge(self, a: dict[int, int], b: dict[int, int]) -> dict[int, int]:
        return {k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()}

    def finish(self, state: dict[int, int]) -> float | None:
        if not state:
            return None
        cells = sorted(state)
        passed = np.cumsum([state[c] for c in cells])
        at = cells[int(np.searchsorted(passed, self.share * passed[-1]))]
        return float("inf") if at == self.cells - 1 else (at + 1) * self.width


class Skill:
    """1 - squared error / squared deviation of the targets from their mean; nothing if the targets do not vary."""

    def start(self) -> tuple[int, float, float, float]:
        return 0, 0.0, 0.0, 0.0

    def add(self, state: tuple, pred: np.ndarray, target: np.ndarray) -> tuple:
        mean = float(target.mean())
        return self.merge(state, (len(target), mean, float(((target - mean) ** 2).sum()), float(((pred - target) ** 2).sum())))

    def merge(self, a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        if not n:
            return a
        gap = b[1] - a[1]
        return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n, a[3] + b[3]

    def finish(self, state: tuple) -> float | None:
        return 1 - state[3] / state[2] if state[2] > 0 else None


def score_functions(df: DataFrame, metrics: Mapping[str, Metric], by: Sequence[str] = (), pred: str = "pred", target: str = "target") -> DataFrame:
    """One row per group with a column per metric, over rows in which neither `pred` nor `target` is missing.

    Groups without such a row give no row. Many groups are no matter: a task passes its states on when it holds
    too many. A group's states are merged in parts first, so no task merges more than its share of them.
    """
    share_library(df.sparkSession)
    keys, names = list(by), list(metrics)
    fields = [df.schema[k] for k in keys]
    states = T.StructType([*fields, T.StructField("_part", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in names)])
    finished = T.StructType([*fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    group = keys or ["_all"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() % PARTS, {}

        def flush() -> pd.DataFrame:
            rows = [(*key, part, *(pickle.dumps(s) for s in found)) for key, found in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*keys, "_part", *names])

        for batch in batches:
            for key, rows in batch.assign(_all=0).groupby(group, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key) if keys else ()
                found = held.get(key) or [m.start() for m in metrics.values()]
                p, t = rows[pred].to_numpy(float), rows[target].to_numpy(float)
                held[key] = [m.add(s, p, t) for m, s in zip(metrics.values(), found)]
            if len(held) >= HELD:
                yield flush()
        yield flush()

    def merged(rows: pd.DataFrame) -> list:
        out = []
        for name, metric in metrics.items():
            found = [pickle.loads(s) for s in rows[name]]
            while len(found) > 1:
                found = [metric.merge(*found[k:k + 2]) if k + 1 < len(found) else found[k] for k in range(0, len(found), 2)]
            out.append(found[0])
        return out

    def own(rows: pd.DataFrame) -> list:
        return [rows[k].iloc[0] for k in keys]

    def some(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*own(rows), rows["_part"].iloc[0], *(pickle.dumps(s) for s in merged(rows)))], columns=[*keys, "_part", *names])

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*own(rows), *(m.finish(s) for m, s in zip(metrics.values(), merged(rows))))], columns=[*keys, *names])

    known = df.select(*keys, F.col(pred).cast("double").alias(pred), F.col(target).cast("double").alias(target)).filter(
        F.col(pred).isNotNull() & F.col(target).isNotNull() & ~F.isnan(pred) & ~F.isnan(target))
    first = known.mapInPandas(fold, states).groupBy(*keys, "_part").applyInPandas(some, states)
    return first.groupBy(*keys).applyInPandas(last, finished)
