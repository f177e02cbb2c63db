"""Stored models, rollouts in physical units, metrics as functions, kernels over tiles."""

import numpy as np
import pytest

from gridspark.operators import forecast, metrics, regrid
from gridspark.sources import models


def model(n_in=2):
    channels = ("a", "b")
    weights = np.array([[0.5, 0.1, 0.0, -0.2], [0.3, 0.0, 0.7, 0.25]])
    return forecast.LinearModel(tuple(forecast.lag_names(channels, n_in)), channels, weights, np.array([0.1, -0.3]))


def test_models_are_versioned(spark, tmp_path):
    path, first = f"{tmp_path}/models", model()
    turned = forecast.LinearModel(first.features[::-1], first.targets[::-1], first.coefficients[::-1, ::-1], first.intercepts[::-1])
    scaler = {"a": (10.0, 2.0), "b": (-5.0, 4.0)}
    assert models.versions(spark, path) == []
    assert models.save_model(spark, path, first) == 1 and models.save_model(spark, path, turned, scaler) == 2
    for version, want, numbers in ((1, first, {}), (None, turned, scaler)):
        got = models.load_model(spark, path, version)
        assert (got.version, got.model.features, got.model.targets, got.scaler) == (version or 2, want.features, want.targets, numbers)
        assert np.array_equal(got.model.coefficients, want.coefficients) and np.array_equal(got.model.intercepts, want.intercepts)
    with pytest.raises(ValueError, match="no such model"):
        models.load_model(spark, path, 7)
    with pytest.raises(ValueError, match="no such model"):
        models.load_model(spark, f"{tmp_path}/nothing")


def test_scaler_numbers(spark):
    fitted = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 2.0)], "channel string, min double, max double")
    assert models.scaler_numbers(fitted) == {"a": (1.0, 4.0), "b": (2.0, 1.0)}


def test_rollout_in_physical_units(spark):
    scaler = {"a": (10.0, 2.0), "b": (-5.0, 4.0)}
    rows = [(0, 0, 12.0, 11.0, -4.0, None), (0, 1, None, None, None, None)]
    state = spark.createDataFrame(rows, "i int, j int, a_lag1 double, a_lag2 double, b_lag1 double, b_lag2 double")
    out = {(r["j"], r["step"]): (r["a"], r["b"]) for r in forecast.rollout_scaled(state, model(), scaler, 2, 5).collect()}
    assert len(out) == 2 * 7
    for j, lags in ((0, [[12.0, 11.0], [-4.0, 0.0]]), (1, [[0.0, 0.0], [0.0, 0.0]])):
        x = np.array(lags)
        offset, divisor = (np.array([scaler[c][k] for c in "ab"]) for k in (0, 1))
        assert np.allclose([out[j, 0], out[j, -1]], x.T)
        z = (x - offset[:, None]) / divisor[:, None]
        for step in range(1, 6):
            y = model().coefficients @ z.ravel() + model().intercepts
            z = np.column_stack([y, z[:, :-1]])
            assert np.allclose(out[j, step], y * divisor + offset)


def pearson():
    """A metric of a caller's own, of sums."""

    class Pearson:
        def start(self):
            return np.zeros(6)

        def add(self, state, pred, target):
            return state + np.array([len(pred), pred.sum(), target.sum(), pred @ pred, target @ target, pred @ target])

        def merge(self, a, b):
            return a + b

        def finish(self, s):
            n, x, y, xx, yy, xy = s
            return float((n * xy - x * y) / np.sqrt((n * xx - x * x) * (n * yy - y * y)))

    return Pearson()


@pytest.mark.parametrize("held", [1, 10_000])
def test_user_functions(spark, monkeypatch, held):
    monkeypatch.setattr(metrics, "HELD", held)
    rng = np.random.default_rng(5)
    target = rng.normal(5, 3, 4000)
    pred = target + rng.normal(0, 1, 4000)
    key = [None if k == 3 else f"k{k}" for k in rng.integers(0, 5, 4000)]
    rows = [(k, float(p), float(t)) for k, p, t in zip(key, pred, target)] + [("k0", None, 1.0), ("k1", 2.0, float("nan")), ("empty", None, None)]
    df = spark.createDataFrame(rows, "k string, pred double, target double").repartition(7)
    functions = {"error": metrics.QuantileError(0.9, 0.01), "skill": metrics.Skill(), "corr": pearson()}
    got = {r["k"]: r for r in metrics.score_functions(df, functions, ["k"]).collect()}
    assert set(got) == set(key)
    for k in got:
        p, t = (x[[a == k for a in key]] for x in (pred, target))
        assert 0 <= got[k]["error"] - np.quantile(abs(p - t), 0.9, method="inverted_cdf") <= 0.01 + 1e-9
        assert np.isclose(got[k]["skill"], 1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum())
        assert np.isclose(got[k]["corr"], np.corrcoef(p, t)[0, 1])
    whole, = metrics.score_functions(df, functions).collect()
    assert np.isclose(whole["corr"], np.corrcoef(pred, target)[0, 1])
    assert metrics.score_functions(df.limit(0), functions, ["k"]).count() == 0


@pytest.mark.parametrize("reach,tile,shape", [(0, 4, (5, 9)), (1, 4, (9, 10)), (3, 3, (7, 11)), (3, 16, (20, 33))])
def test_tiles_with_halos(spark, reach, tile, shape):
    rng = np.random.default_rng(reach)
    weights = {(a, b): float(rng.normal()) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)}
    grids = [np.where(rng.random(shape) < 0.3, np.nan, rng.normal(size=shape)) for _ in range(3)]
    rows = [(t, i, j, None if rng.random() < 0.1 else float(x), float(i)) for t, g in enumerate(grids) for (i, j), x in np.ndenumerate(g) if not np.isnan(x)]
    df = spark.createDataFrame(rows, "t int, i int, j int, v double, w double").repartition(4)
    want = {(r["t"], r["i"], r["j"]): (r["v"], r["w"]) for r in regrid.stencil(df, ["v", "w"], weights, *shape).collect()}
    got = {(r["t"], r["i"], r["j"]): (r["v"], r["w"]) for r in regrid.stencil_tiles(df, ["v", "w"], weights, *shape, tile=tile).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_kernel_wider_than_tiles_is_refused(spark):
    with pytest.raises(ValueError, match="tiles"):
        regrid.stencil_tiles(spark.range(1), [], {(0, 5): 1.0}, 9, 9, tile=4)
