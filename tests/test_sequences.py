"""Running values, splits, sequences, lags, scalers, model and rollout."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridspark.operators import forecast, history, quality, running, scaling, sequences
from gridspark.sources import predictions

# An existing split of 85 sequences with seed 42.
VAL_FILE = [26, 48, 24, 43, 81, 75, 57, 32, 80, 59, 63, 73, 37, 29, 1, 52, 21]
TEST_FILE = [2, 23, 79, 74, 20, 60, 71, 14, 51]
TRAIN_FILE = [78, 0, 68, 22, 12, 82, 10, 18, 4, 66]


def test_running_matches_plain_windows(spark):
    rng = np.random.default_rng(3)
    # one key holds most rows
    rows = [(0 if k % 10 else k % 7 + 1, k, float(rng.normal())) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, o int, v double")
    pdf = pd.DataFrame(rows, columns=["g", "o", "v"]).sort_values("o")
    for inclusive in (True, False):
        got = running.running(df, ["g"], ["o"], F.floor(F.col("o") / 16), {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}, inclusive)
        got = got.toPandas().sort_values("o").reset_index(drop=True)
        base = pdf.groupby("g").v
        for name, want in (("s", base.cumsum()), ("lo", base.cummin()), ("hi", base.cummax())):
            if not inclusive:
                want = want.groupby(pdf.g).shift(1)
            np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(float), rtol=1e-12)


def test_running_gives_the_same_beyond_the_broadcast_bound(spark, monkeypatch):
    from gridspark.operators import small

    monkeypatch.setattr(small, "MAX_BROADCAST_ROWS", 3)
    df = spark.range(100).select(F.lit(0).alias("g"), F.col("id").alias("o"))
    got = running.running(df, ["g"], ["o"], F.floor(F.col("o") / 4), {"n": ("sum", F.lit(1))})
    assert [r["n"] for r in got.orderBy("o").collect()] == list(range(1, 101))


def test_global_rank(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 5003).cast("int").alias("x"))
    got = running.global_rank(df, "x", 0, 5002, n_blocks=16)
    assert all(r["rank"] == k for k, r in enumerate(got.orderBy("x").collect()))


def test_existing_split_is_reproduced(spark):
    got = sequences.cut_order(sequences.legacy_order(spark, 85, 42), 85)
    by = {s: [r["seq_start"] for r in got.filter(F.col("split") == s).orderBy("pos").collect()] for s in ("train", "val", "test")}
    assert {k: len(x) for k, x in by.items()} == {"train": 59, "val": 17, "test": 9}
    assert by["val"] == VAL_FILE and by["test"] == TEST_FILE and by["train"][:10] == TRAIN_FILE


def test_running_keeps_null_keys_and_blocks(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 2, 1), (1, None, 1), (1, 5, 1), (1, 9, 1)], "g int, o int, x int")
    for blocks in (None, 10):
        got = running.running(df, ["g"], ["o"], F.floor(F.col("o") / 4), {"n": ("sum", F.col("x"))}, blocks=blocks)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, 1, 1, 1), (None, 2, 1, 2), (1, None, 1, 1), (1, 5, 1, 2), (1, 9, 1, 3)], key=repr)


@pytest.mark.parametrize("chunk", [1, 4, 6])
def test_lags_do_not_depend_on_the_chunk(spark, chunk):
    df = spark.range(24).select(F.col("id").cast("int").alias("t"), F.lit(0).alias("i"), F.lit(0).alias("j"), (F.col("id") * 1.5).alias("v"))
    rows = lambda c: sorted(map(tuple, sequences.lag_features(df, ["v"], 6, chunk=c).collect()))
    assert rows(chunk) == rows(512)


def test_fit_keeps_digits_of_large_values(spark):
    rng = np.random.default_rng(0)
    x = 1e7 + rng.normal(size=500)
    df = spark.createDataFrame([(float(a), float(2 * a + 3)) for a in x] + [(float("nan"), 1.0), (None, 2.0)], "x double, y double")
    assert abs(forecast.fit_linear(df, ["x"], ["y"]).coefficients[0, 0] - 2) < 1e-3


def test_split_partitions_all_starts(spark):
    starts = sequences.sequence_starts(spark, 91)
    split = sequences.split_sequences(starts, 85, seed=1)
    rows = split.collect()
    assert sorted(r["seq_start"] for r in rows) == list(range(85))
    for s, n in (("train", 59), ("val", 17), ("test", 9)):
        assert sorted(r["pos"] for r in rows if r["split"] == s) == list(range(n))
    again = sequences.split_sequences(starts.repartition(5), 85, seed=1)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert sorted(map(tuple, sequences.split_sequences(starts, 85, seed=2).collect())) != sorted(map(tuple, rows))


def test_too_few_frames_make_no_sequences(spark):
    df = spark.createDataFrame([(t, 0, 0) for t in range(5)], "t int, i int, j int")
    assert sequences.make_sequences(df, 6, 1).count() == 0
    assert sequences.make_sequences(df, 3, 1).count() == 2 * 4


def test_out_of_range_start_is_an_error(spark):
    ok = spark.createDataFrame([(0,), (23,)], "seq_start int")
    assert sequences.check_starts(ok, 30).count() == 2
    for bad in (-1, 24):
        with pytest.raises(PySparkException, match="out of range"):
            sequences.check_starts(spark.createDataFrame([(bad,)], "seq_start int"), 30).collect()


@pytest.mark.parametrize("chunk", [7, 16, 512])
def test_lags_are_by_step_and_survive_chunks(spark, chunk):
    steps = [t for t in range(60) if t % 11 != 5]
    df = spark.createDataFrame([(t, 0, c, float(100 * c + t)) for c in (0, 1) for t in steps], "t int, i int, j int, v double")
    got = sequences.lag_features(df, ["v"], 6, chunk=chunk).collect()
    assert len(got) == 2 * len(steps)
    for r in got:
        for k in range(1, 7):
            want = 100.0 * r["j"] + r["t"] - k if r["t"] - k in steps else None
            assert r[f"v_lag{k}"] == want


def expand(values, starts, length):
    return np.concatenate([values[s:s + length] for s in starts])


@pytest.mark.parametrize("cells", [None, 6])
def test_scaler_equals_the_expanded_data(spark, cells):
    rng = np.random.default_rng(5)
    cube = rng.normal(5, 2, size=(12, 4))
    cube[2, 1] = np.nan
    rows = [(t, 0, c, None if np.isnan(cube[t, c]) else float(cube[t, c]), 7.0) for t in range(12) for c in range(4) if t != 9]
    df = spark.createDataFrame(rows, "t int, i int, j int, v double, k double")
    starts = spark.createDataFrame([(0,), (1,), (4,)], "seq_start int")
    full = np.nan_to_num(cube)
    if cells:
        full[9] = 0
        data = expand(np.pad(full, ((0, 0), (0, 2))), (0, 1, 4), 7).ravel()
    else:
        data = np.concatenate([full[t] for s in (0, 1, 4) for t in range(s, s + 7) if t != 9])
    fit = {r["channel"]: r for r in scaling.fit_scaler(df, starts, ["v", "k"], cells_per_frame=cells).collect()}
    assert fit["v"]["mean"] == pytest.approx(data.mean()) and fit["v"]["scale"] == pytest.approx(data.std())
    if not cells:
        assert (fit["k"]["mean"], fit["k"]["scale"]) == (7.0, 1.0)
    ends = {r["channel"]: r for r in scaling.fit_scaler(df, starts, ["v"], kind="minmax", cells_per_frame=cells).collect()}
    assert (ends["v"]["min"], ends["v"]["max"]) == (data.min(), data.max())


def test_scaling_round_trip_and_storage(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0, 4.0), (1, 3.0, 4.0)], "t int, a double, b double")
    scaler = spark.createDataFrame([("a", 2.0, 1.0), ("b", 4.0, 1.0)], "channel string, mean double, scale double")
    scaling.save_scaler(scaler, str(tmp_path / "s"))
    scaler = scaling.load_scaler(spark, str(tmp_path / "s"))
    scaled = scaling.transform(df, scaler, ["a", "b"])
    assert [tuple(r) for r in scaled.orderBy("t").collect()] == [(0, -1.0, 0.0), (1, 1.0, 0.0)]
    assert [tuple(r) for r in scaling.inverse_transform(scaled, scaler, ["a", "b"]).orderBy("t").collect()] == [(0, 1.0, 4.0), (1, 3.0, 4.0)]
    flat = spark.createDataFrame([("a", 1.0, 3.0), ("b", 4.0, 4.0)], "channel string, min double, max double")
    assert [tuple(r) for r in scaling.transform(df, flat, ["a", "b"]).orderBy("t").collect()] == [(0, 0.0, 0.0), (1, 1.0, 0.0)]
    assert scaling.transform(df, None, ["a"]) is df


def test_zscore_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (300.0, 5.0)] + [(1.5, 5.0)] * 20, "a double, b double")
    got = scaling.zscore_clip(df, ["a", "b"]).collect()
    assert max(r["a"] for r in got) == pytest.approx(math.pi) and {r["b"] for r in got} == {0.0}


def test_early_stopping_like_a_training_loop(spark):
    rng = np.random.default_rng(7)
    runs = {r: list(rng.normal(size=50) - 0.02 * np.arange(50)) for r in range(3)}
    runs[3] = [1.0, 0.9, float("nan"), 0.9, 0.8] + [0.8] * 10
    rows = [(r, e + 1 if r != 1 else e + 51, float(m)) for r, ms in runs.items() for e, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "run int, epoch int, metric double")
    got = {(r["run"], r["epoch"]): r for r in history.early_stopping(df, patience=5, block=8).collect()}
    summary = {r["run"]: r for r in history.stop_summary(history.early_stopping(df, patience=5)).collect()}
    for run, ms in runs.items():
        best, counter, stop, best_at = math.inf, 0, None, None
        for e, m in enumerate(ms):
            epoch = e + 1 if run != 1 else e + 51
            is_best = m < best
            best, counter = (m, 0) if is_best else (best, counter + 1)
            assert (got[run, epoch]["is_best"], got[run, epoch]["epochs_since_best"]) == (is_best, counter)
            if stop is None:
                best_at = epoch if is_best else best_at
                final = best
                stop = epoch if counter >= 5 else None
        assert (summary[run]["stop_epoch"], summary[run]["best_epoch"], summary[run]["best_metric"]) == (stop, best_at, final)


def test_linear_fit_finds_the_truth(spark):
    rng = np.random.default_rng(11)
    x = rng.normal([1, 50, 3], [1, 5, 0], size=(400, 3))
    y = np.column_stack([x @ [2.0, -0.5, 0] + 4, x @ [0, 0.25, 0] - 1])
    rows = [tuple(map(float, r)) for r in np.column_stack([x, y])] + [(None, 1.0, 3.0, 9.0, 9.0)]
    model = forecast.fit_linear(spark.createDataFrame(rows, "a double, b double, c double, y double, z double"), ["a", "b", "c"], ["y", "z"])
    np.testing.assert_allclose(model.coefficients, [[2.0, -0.5, 0], [0, 0.25, 0]], atol=1e-9)
    np.testing.assert_allclose(model.intercepts, [4, -1], atol=1e-7)


def test_rollout_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    channels = ["p", "q"]
    names = forecast.lag_names(channels, 3)
    model = forecast.LinearModel(tuple(names), tuple(channels), rng.normal(scale=0.4, size=(2, 6)), np.array([0.1, -0.2]))
    start = rng.normal(size=(5, 6))
    state = spark.createDataFrame([(k, 0, *map(float, r)) for k, r in enumerate(start)], "i int, j int, " + ", ".join(f"{n} double" for n in names))
    got = {(r["i"], r["step"]): (r["p"], r["q"]) for r in forecast.rollout(state, model, 3, 4).collect()}
    assert len(got) == 20
    for k in range(5):
        p, q = list(start[k, :3]), list(start[k, 3:])
        for step in range(1, 5):
            y = model.coefficients @ np.array(p[:3] + q[:3]) + model.intercepts
            assert got[k, step] == pytest.approx(tuple(y))
            p, q = [y[0], *p], [y[1], *q]


def test_short_last_batch_changes_the_mean(spark):
    rows = [(b, s, float(e), 0.0) for b, s, e in [(0, 0, 1), (0, 1, 1), (0, 2, 1), (0, 3, 1), (1, 4, 3)]]
    scores = forecast.batch_scores(spark.createDataFrame(rows, "batch int, sample int, pred double, target double"))
    assert forecast.sample_mse(scores).first()["mse"] == pytest.approx(13 / 5)
    assert forecast.batch_mse(scores).first()["mse"] == pytest.approx(5.0)
    for how in ({}, {"block": 1}, {"n_batches": 2}):
        last = forecast.running_mse(scores, **how).orderBy("batch").collect()[-1]
        assert (last["running_by_sample"], last["running_by_batch"]) == (pytest.approx(13 / 5), pytest.approx(5.0))


def test_predictions_need_their_columns(spark):
    with pytest.raises(ValueError):
        predictions.last_predictions(spark.range(1))


def test_broken_splits_are_reported(spark):
    def verdict(values, declared):
        df = spark.createDataFrame([("train", k, x) for k, x in enumerate(values)], "split string, pos int, seq_start int")
        return {r["check"]: r["ok"] for r in quality.validate_split(df, 5, declared).collect()}

    assert all(verdict([0, 1, 4], 3).values())
    assert not verdict([0, 1, 1], 3)["duplicates"] and not verdict([0, 5], 2)["highest"] and not verdict([-1, 2], 2)["lowest"] and not verdict([0, 2], 3)["total"]


def test_histogram_equals_numpy(spark):
    x = np.round(np.random.default_rng(4).gamma(2.0, 3.0, 2000), 3)
    got = quality.histogram(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", 50).orderBy("bin").collect()
    assert [r["n"] for r in got] == np.histogram(x, 50)[0].tolist()
    flat = quality.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in flat] == np.histogram([2.0, 2.0], 4)[0].tolist()


def test_lag_model_scores_equal_least_squares(spark):
    """The registered query against NumPy on the densely laid out cube."""
    import __spark_entry__ as entry
    from gridspark.plans import sequence_queries as q, views as v

    cube = v.cube_wide(spark, entry.SMOKE_DIR).toPandas()
    dense = np.zeros((v.N_TIME, v.N_LAT, v.N_LON, 5))
    for r in cube.itertuples():
        dense[r.t, r.i, r.j] = np.nan_to_num([getattr(r, c) for c in v.CHANNELS])
    member = {r["seq_start"]: r["split"] for r in q.known_splits(spark).collect()}
    rows = [(member[r.t - 6], dense[r.t - 6:r.t, r.i, r.j][::-1].T.ravel(), dense[r.t, r.i, r.j]) for r in cube.itertuples() if r.t >= 6]
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    split = np.array([r[0] for r in rows])
    train = split == "train"
    beta = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x])[train], y[train], rcond=None)[0]
    pred = np.column_stack([np.ones(len(x)), x]) @ beta
    got = {(r["split"], r["channel"]): (r["mse"], r["mse_persistence"]) for r in entry.queries()["lag_model_scores"](spark, entry.SMOKE_DIR).collect()}
    for s in ("train", "val", "test"):
        for k, c in enumerate(v.CHANNELS):
            want = (((pred - y)[split == s, k] ** 2).mean(), ((x[:, 6 * k] - y[:, k])[split == s] ** 2).mean())
            assert got[s, c] == pytest.approx(want, rel=1e-5)


def test_neighbour_model_equals_least_squares(spark):
    import __spark_entry__ as entry
    from gridspark.plans import views as v

    cube = v.cube_wide(spark, entry.SMOKE_DIR).select("t", "i", "j", "v_view").toPandas()
    known = {(r.t, r.i, r.j): r.v_view for r in cube.itertuples()}
    value = lambda t, i, j: np.nan_to_num(known.get((t, i, j), 0.0))
    near = lambda t, i, j: sum(value(t, i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) / 9
    cells = {(t, i + a, j + b) for t, i, j in known for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= i + a < v.N_LAT and 0 <= j + b < v.N_LON}
    rows = [(t, i, j) for t, i, j in cells if t >= 2 and np.isfinite(known.get((t, i, j), np.nan))]
    x = np.array([[1, value(t - 1, i, j), value(t - 2, i, j), near(t - 1, i, j), near(t - 2, i, j)] for t, i, j in rows])
    beta = np.linalg.lstsq(x, np.array([known[r] for r in rows]), rcond=None)[0]
    got = {r["feature"]: r["value"] for r in entry.queries()["lag_model_neighbours"](spark, entry.SMOKE_DIR).collect()}
    assert [got[f] for f in ("intercept", "v_view_lag1", "v_view_lag2", "v_view_near_lag1", "v_view_near_lag2")] == pytest.approx(list(beta), abs=2e-6)
