"""Sequences, splits, scalers, scores, forecasts, histories."""

from __future__ import annotations

import uuid
from datetime import timedelta

import numpy as np
from pyspark.sql import functions as F

from gridspark.functions.missing import fill_missing
from gridspark.operators import axes, fill, forecast, history, metrics, quality, regrid, scaling, sequences
from gridspark.operators.small import join_small
from gridspark.plans import views as v
from gridspark.plans.grid_queries import rounded
from gridspark.plans.registry import query
from gridspark.session import shared_dir
from gridspark.sources import models, predictions, splits as split_files

VALUES = list(v.CHANNELS)
_COLS = ", ".join(VALUES)


def order_key(seed: int):
    """An order both engines compute alike, with values below 10007."""
    return (F.col("seq_start") * 7919 + seed) % 10007


def starts(spark, d):
    """Sequence starts the cube has frames for."""
    return v.table(spark, d, "events").select(F.datediff(F.to_date("ts"), F.lit(v.EPOCH)).alias("seq_start")).distinct().filter(F.col("seq_start") < v.N_SEQ)


def splits(spark, d):
    """The split of the starts found in the data."""
    return sequences.split_sequences(starts(spark, d), v.N_SEQ, key=order_key(42), key_range=10007)


def known_splits(spark):
    """The same split for queries that read the cube anyway: the starts follow from its length."""
    return sequences.split_sequences(sequences.sequence_starts(spark, v.N_TIME, v.N_IN, v.N_OUT), v.N_SEQ, key=order_key(42), key_range=10007)


def train_starts(spark):
    return known_splits(spark).filter("split = 'train'").select("seq_start")


@query("make_sequences", f"SELECT t, i, j, {_COLS}, seq_start, step, role FROM seq_rows")
def make_sequences(spark, d):
    return sequences.make_sequences(v.cube_wide(spark, d).drop("time"), v.N_IN, v.N_OUT, v.N_TIME)


@query("gather_sequences", f"SELECT t, i, j, {_COLS}, seq_start, step, role FROM seq_rows WHERE seq_start IN (SELECT seq_start FROM splits WHERE split = 'val')")
def gather_sequences(spark, d):
    val = known_splits(spark).filter("split = 'val'").select("seq_start")
    return sequences.gather_sequences(v.cube_wide(spark, d).drop("time"), val, v.N_IN, v.N_OUT, v.N_SEQ)


@query("split_members", "SELECT t, i, j, v_view, seq_start, step FROM seq_rows WHERE seq_start IN (SELECT seq_start FROM splits WHERE split = 'test')")
def split_members(spark, d):
    rows = sequences.make_sequences(v.cube_wide(spark, d).select("t", "i", "j", "v_view"), v.N_IN, v.N_OUT, v.N_TIME).drop("role")
    return sequences.split_members(rows, known_splits(spark), "test", n_starts=v.N_SEQ)


@query("checked_starts", "SELECT seq_start FROM seqs")
def checked_starts(spark, d):
    return sequences.check_starts(starts(spark, d), v.N_TIME, v.N_IN, v.N_OUT)


@query("lag_features", "SELECT c.t, c.i, c.j, c.v_view, " + ", ".join(f"l{k}.v_view AS v_view_lag{k}" for k in range(1, 7)) + " FROM cube_wide c " + " ".join(
    f"LEFT JOIN cube_wide l{k} ON l{k}.t = c.t - {k} AND l{k}.i = c.i AND l{k}.j = c.j" for k in range(1, 7)))
def lag_features(spark, d):
    return sequences.lag_features(v.cube_wide(spark, d).select("t", "i", "j", "v_view"), ["v_view"], v.N_IN, chunk=16)


@query("ratio_split", "SELECT split, pos, seq_start FROM splits")
def ratio_split(spark, d):
    return splits(spark, d)


@query("sample_n", "SELECT seq_start FROM splits WHERE split = 'train' ORDER BY (seq_start * 7919 + 7) % 10007, seq_start LIMIT 10")
def sample_n(spark, d):
    return sequences.sample_n(splits(spark, d).filter("split = 'train'").select("seq_start"), 10, key=order_key(7))


@query("batch_id", "SELECT split, pos, seq_start, (pos // 4)::INT AS batch FROM splits")
def batch_id(spark, d):
    return sequences.batch_id(splits(spark, d), 4)


@query("validate_split", """
    SELECT 'duplicates' AS "check", count(*) - count(DISTINCT seq_start) AS observed, count(*) = count(DISTINCT seq_start) AS ok FROM splits
    UNION ALL SELECT 'lowest', min(seq_start), min(seq_start) >= 0 FROM splits UNION ALL SELECT 'highest', max(seq_start), max(seq_start) < 24 FROM splits
    UNION ALL SELECT 'total', count(*), count(*) = 24 FROM splits""")
def validate_split(spark, d):
    return quality.validate_split(splits(spark, d), v.N_SEQ, 24)


@query("split_summary", """
    SELECT split, count(*) AS n, round(count(*) * 100.0::DOUBLE / 24, 6) AS percent, min(seq_start)::INT AS lowest, max(seq_start)::INT AS highest,
           array_to_string(list(seq_start ORDER BY pos)[1:5], ',') AS sample FROM splits GROUP BY split""")
def split_summary(spark, d):
    return rounded(quality.split_summary(splits(spark, d)), ["percent"]).withColumn("sample", F.array_join(F.col("sample").cast("array<string>"), ","))


@query("split_info", "SELECT 24 AS total_sequences, 7 AS total_seq_len, 16 AS train_end, 21 AS val_end, count(*) FILTER (WHERE split = 'train')::INT AS train, "
                     "count(*) FILTER (WHERE split = 'val')::INT AS val, count(*) FILTER (WHERE split = 'test')::INT AS test FROM splits")
def split_info(spark, d):
    info = split_files.split_info(splits(spark, d), "events", v.N_IN, v.N_OUT, v.N_SEQ, (0.7, 0.2, 0.1), 42)
    return info.select("total_sequences", "total_seq_len", "train_end", "val_end", *(F.col("splits")[s].alias(s) for s in ("train", "val", "test")))


@query("split_index_text", "SELECT split, pos, seq_start FROM splits")
def split_index_text(spark, d):
    """The splits written as index texts, one number per line with a blank line, and read back."""
    texts = splits(spark, d).groupBy("split").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "seq_start"))), lambda s: s["seq_start"].cast("string")), "\n").alias("value"))
    return split_files.parse_index_text(texts.withColumn("value", F.concat("value", F.lit("\n\n"))), keys=("split",))


_LONG_TRAIN = "SELECT '{c}' AS channel, coalesce({c}, 0) AS x FROM seq_rows WHERE seq_start IN (SELECT seq_start FROM splits WHERE split = 'train')"
_FIT_ROWS = " UNION ALL ".join(_LONG_TRAIN.format(c=c) for c in VALUES)


@query("fit_standard", f"SELECT channel, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS scale FROM ({_FIT_ROWS}) GROUP BY channel")
def fit_standard(spark, d):
    return rounded(scaling.fit_scaler(v.cube_wide(spark, d), train_starts(spark), VALUES, n_starts=v.N_SEQ), ["mean", "scale"])


@query("fit_minmax", f"SELECT channel, min(x) AS min, max(x) AS max FROM ({_FIT_ROWS}) GROUP BY channel")
def fit_minmax(spark, d):
    return scaling.fit_scaler(v.cube_wide(spark, d), train_starts(spark), VALUES, kind="minmax", n_starts=v.N_SEQ)


@query("fit_standard_dense", """
    WITH g AS (SELECT t::INT AS t, i::INT AS i, j::INT AS j FROM range(30) a(t), range(12) b(i), range(24) c(j)),
         dense AS (SELECT g.t, coalesce(v_view, 0) AS x FROM g LEFT JOIN cube_wide USING (t, i, j))
    SELECT 'v_view' AS channel, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS scale FROM dense JOIN splits s ON split = 'train' AND t >= s.seq_start AND t < s.seq_start + 7""")
def fit_standard_dense(spark, d):
    fitted = scaling.fit_scaler(v.cube_wide(spark, d), train_starts(spark), ["v_view"], cells_per_frame=v.N_LAT * v.N_LON, n_starts=v.N_SEQ)
    return rounded(fitted, ["mean", "scale"])


_SCALER_SQL = f"sc AS (SELECT channel, avg(x) AS m, stddev_pop(x) AS s, min(x) AS lo, max(x) AS hi FROM ({_FIT_ROWS}) GROUP BY channel)"


@query("scale", f"WITH {_SCALER_SQL} SELECT t, i, j, " + ", ".join(
    f"round((coalesce({c}, 0) - (SELECT m FROM sc WHERE channel = '{c}')) / (SELECT s FROM sc WHERE channel = '{c}'), 6) + 0.0 AS {c}" for c in VALUES) + " FROM cube_wide")
def scale(spark, d):
    cube = fill_missing(v.cube_wide(spark, d).drop("time"), VALUES)
    return rounded(scaling.transform(cube, scaling.fit_scaler(cube, train_starts(spark), VALUES, n_starts=v.N_SEQ), VALUES), VALUES)


@query("scale_minmax", f"WITH {_SCALER_SQL} SELECT t, i, j, " + ", ".join(
    f"round((coalesce({c}, 0) - (SELECT lo FROM sc WHERE channel = '{c}')) / (SELECT hi - lo FROM sc WHERE channel = '{c}'), 6) + 0.0 AS {c}" for c in VALUES) + " FROM cube_wide")
def scale_minmax(spark, d):
    cube = fill_missing(v.cube_wide(spark, d).select("t", "i", "j", *VALUES), VALUES)
    return rounded(scaling.transform(cube, scaling.fit_scaler(cube, train_starts(spark), VALUES, kind="minmax", n_starts=v.N_SEQ), VALUES), VALUES)


@query("unscale", "SELECT t, i, j, " + ", ".join(f"round(coalesce({c}, 0), 6) + 0.0 AS {c}" for c in VALUES) + " FROM cube_wide")
def unscale(spark, d):
    cube = fill_missing(v.cube_wide(spark, d).drop("time"), VALUES)
    scaler = scaling.fixed(scaling.fit_scaler(cube, train_starts(spark), VALUES, n_starts=v.N_SEQ))
    return rounded(scaling.inverse_transform(scaling.transform(cube, scaler, VALUES), scaler, VALUES), VALUES)


@query("zscore_clip", """
    WITH s AS (SELECT k, avg(x) AS m, CASE WHEN stddev_samp(x) < 1e-6 THEN 1 ELSE stddev_samp(x) END AS sd FROM vectors GROUP BY k)
    SELECT vec_id, k, round(greatest(-3, least(3, (x - m) / sd)) * pi() / 3, 6) + 0.0 AS x FROM vectors JOIN s USING (k)""")
def zscore_clip(spark, d):
    return rounded(scaling.zscore_clip_by(v.vectors(spark, d), "k", "x").select("vec_id", "k", "x"), ["x"])


@query("zscore_clip_columns", """
    SELECT l_orderkey, l_linenumber, round(greatest(-3, least(3, (par - (SELECT avg(par) FROM ocean)) / (SELECT stddev_samp(par) FROM ocean))) * pi() / 3, 6) + 0.0 AS par,
           round(greatest(-3, least(3, (wind - (SELECT avg(wind) FROM ocean)) / (SELECT stddev_samp(wind) FROM ocean))) * pi() / 3, 6) + 0.0 AS wind FROM ocean""")
def zscore_clip_columns(spark, d):
    cols = ["par", "wind"]
    return rounded(scaling.zscore_clip(v.ocean(spark, d).select("l_orderkey", "l_linenumber", *cols), cols), cols)


@query("early_stopping", """
    WITH b AS (SELECT *, coalesce(metric < min(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM history),
         c AS (SELECT *, (epoch - coalesce(max(CASE WHEN is_best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch), 0))::INT AS epochs_since_best FROM b)
    SELECT run, epoch, metric, is_best, epochs_since_best, epochs_since_best >= 3 AS should_stop FROM c""")
def early_stopping(spark, d):
    return history.early_stopping(v.history(spark, d), patience=3, block=8)


@query("stop_summary", """
    WITH b AS (SELECT *, coalesce(metric < min(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM history),
         c AS (SELECT *, epoch - coalesce(max(CASE WHEN is_best THEN epoch END) OVER (PARTITION BY run ORDER BY epoch), 0) AS since FROM b),
         s AS (SELECT run, min(epoch) FILTER (WHERE since >= 3)::INT AS stop_epoch FROM c GROUP BY run)
    SELECT s.run, s.stop_epoch, min(metric) AS best_metric, max(epoch)::INT AS best_epoch FROM s JOIN c ON c.run = s.run AND is_best AND epoch <= coalesce(stop_epoch, 99) GROUP BY s.run, s.stop_epoch""")
def stop_summary(spark, d):
    return history.stop_summary(history.early_stopping(v.history(spark, d), patience=3))


# persistence pairs: every cell and channel against its previous day, one sample per sequence
_PAIRS = ("pairs AS (SELECT s.split, s.pos // 4 AS batch, s.seq_start AS sample, c.var AS channel, c.i, c.j, p.value AS pred, c.value AS target FROM cube_long c "
          "JOIN cube_long p ON p.t = c.t - 1 AND p.i = c.i AND p.j = c.j AND p.var = c.var JOIN splits s ON s.seq_start = c.t - 6)")


def scored(spark, d):
    lagged = sequences.lag_features(v.cube_long(spark, d), ["value"], 1, cell=["i", "j", "var"])
    pairs = lagged.filter((F.col("t") >= v.N_IN) & F.col("value_lag1").isNotNull()).select(
        (F.col("t") - v.N_IN).alias("seq_start"), F.col("var").alias("channel"), "i", "j", F.col("value_lag1").alias("pred"), F.col("value").alias("target"))
    members = sequences.batch_id(known_splits(spark), 4)
    return join_small(pairs, members, "seq_start", rows=v.N_SEQ).withColumnRenamed("seq_start", "sample")


@query("score_join", f"WITH {_PAIRS} SELECT sample, channel, i, j, pred, target FROM pairs")
def score_join(spark, d):
    cells = v.cube_long(spark, d).withColumnRenamed("var", "channel")
    last_input = cells.select((F.col("t") - v.N_IN + 1).alias("sample"), F.lit(0).alias("step"), "channel", "i", "j", "value").filter(F.col("sample").between(0, v.N_SEQ - 1))
    target = cells.select((F.col("t") - v.N_IN).alias("sample"), F.lit(0).alias("step"), "channel", "i", "j", "value").filter(F.col("sample") >= 0)
    return forecast.score_join(last_input, target).drop("step")


@query("mse_sample", f"WITH {_PAIRS} SELECT split, round(sum(m * n) / sum(n), 6) AS mse FROM (SELECT split, batch, avg(pow(pred - target, 2)) AS m, count(DISTINCT sample) AS n FROM pairs GROUP BY ALL) GROUP BY split")
def mse_sample(spark, d):
    return rounded(forecast.sample_mse(forecast.batch_scores(scored(spark, d), by=["split"]), by=["split"]), ["mse"])


@query("mse_batch", f"WITH {_PAIRS} SELECT split, round(avg(m), 6) AS mse FROM (SELECT split, batch, avg(pow(pred - target, 2)) AS m FROM pairs GROUP BY split, batch) GROUP BY split")
def mse_batch(spark, d):
    return rounded(forecast.batch_mse(forecast.batch_scores(scored(spark, d), by=["split"]), by=["split"]), ["mse"])


@query("mse_running", f"""
    WITH {_PAIRS}, b AS (SELECT split, batch, avg(pow(pred - target, 2)) AS m, count(DISTINCT sample) AS n FROM pairs GROUP BY split, batch)
    SELECT split, batch::INT AS batch, round(sum(m * n) OVER w / sum(n) OVER w, 6) AS running_by_sample, round(avg(m) OVER w, 6) AS running_by_batch
    FROM b WINDOW w AS (PARTITION BY split ORDER BY batch)""")
def mse_running(spark, d):
    batches = forecast.batch_scores(scored(spark, d), by=["split"])
    return rounded(forecast.running_mse(batches, n_batches=v.N_SEQ, by=["split"]), ["running_by_sample", "running_by_batch"])


@query("user_metrics", f"""
    WITH {_PAIRS} SELECT channel, round(avg(pow(pred - target, 2)), 6) AS mse, round(avg(abs(pred - target)), 6) AS mae, round(max(abs(pred - target)), 6) AS worst FROM pairs GROUP BY channel""")
def user_metrics(spark, d):
    gap = F.abs(F.col("pred") - F.col("target"))
    return rounded(forecast.score(scored(spark, d), {"mae": F.avg(gap), "worst": F.max(gap)}, by=["channel"]), ["mse", "mae", "worst"])


@query("user_functions", f"""
    WITH {_PAIRS}, h AS (SELECT channel, least(floor(abs(pred - target) / 0.25), 65535)::INT AS cell, count(*) AS n FROM pairs GROUP BY ALL),
         c AS (SELECT channel, cell, sum(n) OVER (PARTITION BY channel ORDER BY cell) AS passed, sum(n) OVER (PARTITION BY channel) AS total FROM h),
         q AS (SELECT channel, (min(cell) + 1) * 0.25::DOUBLE AS median_error FROM c WHERE passed >= 0.5 * total GROUP BY channel),
         m AS (SELECT *, avg(target) OVER (PARTITION BY channel) AS mu FROM pairs)
    SELECT channel, any_value(median_error) AS median_error, round(1 - sum(pow(pred - target, 2)) / sum(pow(target - mu, 2)), 6) AS skill FROM m JOIN q USING (channel) GROUP BY channel""")
def user_functions(spark, d):
    """Metrics that are functions of whole outputs: no aggregate column states them."""
    return rounded(metrics.score_functions(scored(spark, d), {"median_error": metrics.QuantileError(0.5, 0.25), "skill": metrics.Skill()}, by=["channel"]), ["skill"])


@query("rollout_persistence", "SELECT a.i::INT AS i, b.j::INT AS j, h::INT AS step, " + ", ".join(f"round(coalesce(max({c}), 0), 6) + 0.0 AS {c}" for c in VALUES) +
       " FROM range(12) a(i) CROSS JOIN range(24) b(j) CROSS JOIN range(1, 11) r(h) LEFT JOIN cube_wide c ON c.i = a.i AND c.j = b.j AND c.t = 29 GROUP BY a.i, b.j, h")
def rollout_persistence(spark, d):
    """Every cell of the grid, also those without a recent row, whose input is 0."""
    state = forecast.last_lags(v.cube_wide(spark, d), VALUES, v.N_IN, v.N_TIME, cells=axes.grid(spark, v.N_LAT, v.N_LON))
    return rounded(forecast.rollout(state, forecast.persistence(VALUES, v.N_IN), v.N_IN, 10), VALUES)


@query("lag_model", """
    WITH p AS (SELECT c.v_view AS y, l.v_view AS x FROM (SELECT t, i, j, coalesce(v_view, 0) AS v_view FROM cube_wide) c
               JOIN (SELECT t, i, j, coalesce(v_view, 0) AS v_view FROM cube_wide) l ON l.t = c.t - 1 AND l.i = c.i AND l.j = c.j)
    SELECT 'v_view' AS target, 'v_view_lag1' AS feature, round(regr_slope(y, x), 6) + 0.0 AS value FROM p
    UNION ALL SELECT 'v_view', 'intercept', round(regr_intercept(y, x), 6) + 0.0 FROM p""")
def lag_model(spark, d):
    cube = fill_missing(v.cube_wide(spark, d).select("t", "i", "j", "v_view"), ["v_view"])
    lagged = sequences.lag_features(cube, ["v_view"], 1).filter("v_view_lag1 IS NOT NULL")
    return rounded(forecast.fit_lag_model(lagged, ["v_view"], 1).table(spark), ["value"])


@query("lag_model_mse", """
    WITH c AS (SELECT t, i, j, coalesce(v_view, 0) AS v FROM cube_wide),
         p AS (SELECT s.split, c.v AS y, l.v AS x FROM c JOIN c l ON l.t = c.t - 1 AND l.i = c.i AND l.j = c.j JOIN splits s ON s.seq_start = c.t - 6),
         m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM p WHERE split = 'train')
    SELECT split, round(avg(pow(y - (a * x + b), 2)), 6) AS mse, round(avg(pow(y - x, 2)), 6) AS mse_persistence FROM p, m GROUP BY split""")
def lag_model_mse(spark, d):
    """One lag of one channel, fitted on the training sequences and scored on all splits."""
    cube = fill_missing(v.cube_wide(spark, d).select("t", "i", "j", "v_view"), ["v_view"])
    lagged = sequences.lag_features(cube, ["v_view"], 1).filter((F.col("t") >= v.N_IN) & F.col("v_view_lag1").isNotNull())
    rows = join_small(lagged.withColumn("seq_start", F.col("t") - v.N_IN), known_splits(spark).drop("pos"), "seq_start", rows=v.N_SEQ)
    model = forecast.fit_lag_model(rows.filter("split = 'train'"), ["v_view"], 1)
    predicted = model.predict(rows).select("split", F.col("v_view").alias("target"), F.col("v_view_pred").alias("pred"), F.col("v_view_lag1").alias("last"))
    scores = forecast.score(predicted, {"mse_persistence": F.avg(forecast.squared_error("last"))}, by=["split"])
    return rounded(scores, ["mse", "mse_persistence"])


def least_squares(rows: str, features: list[str], targets: list[str]) -> str:
    """CTEs `beta(r, b)` and `base(a)` in SQL: for each feature the list of its weights by target, and the intercepts by target.

    The normal equations of the view `rows`, in units of the features' deviations, solved by elimination: a step per
    feature divides the pivot row and clears its column in all others.
    """
    p, n = len(features), len(features) + len(targets)
    line = lambda f: "[" + ", ".join(f"covar_pop({f}, {g}) / stddev_pop({f}) / stddev_pop({g})" for g in features) + ", " + ", ".join(f"covar_pop({f}, {y}) / stddev_pop({f})" for y in targets) + "]"
    return f"""
        moments AS (SELECT [{", ".join(line(f) for f in features)}] AS m, [{", ".join(f"stddev_pop({f})" for f in features)}] AS s, [{", ".join(f"avg({f})" for f in features)}] AS mf,
                           [{", ".join(f"avg({y})" for y in targets)}] AS my FROM {rows}),
        solved(step, r, line) AS (
            SELECT 1, r::INT, m[r] FROM moments, range(1, {p + 1}) x(r)
            UNION ALL
            SELECT step + 1, r, CASE WHEN r = step THEN list_transform(line, lambda x: x / line[step])
                                     ELSE list_transform(range(1, {n + 1}), lambda k: line[k] - line[step] * top[k] / top[step]) END
            FROM (SELECT step, r, line, max(CASE WHEN r = step THEN line END) OVER () AS top FROM solved WHERE step <= {p})),
        beta AS (SELECT r, list_transform(line[{p + 1}:{n}], lambda x: x / s[r]) AS b FROM solved, moments WHERE step = {p + 1}),
        base AS (SELECT list_transform(range(1, {len(targets) + 1}), lambda k: my[k] - list_sum(list_transform(bs, lambda x: x.b[k] * mf[x.r]))) AS a
                 FROM moments, (SELECT list({{'r': r, 'b': b}} ORDER BY r) AS bs FROM beta))"""


_LAGS = forecast.lag_names(VALUES, v.N_IN)
_LAGGED = ("filled AS (SELECT t, i, j, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in VALUES) + " FROM cube_wide), lagged AS (SELECT c.*, " +
           ", ".join(f"coalesce(l{k}.{c}, 0) AS {c}_lag{k}" for c in VALUES for k in range(1, v.N_IN + 1)) + " FROM filled c " +
           " ".join(f"LEFT JOIN filled l{k} ON l{k}.t = c.t - {k} AND l{k}.i = c.i AND l{k}.j = c.j" for k in range(1, v.N_IN + 1)) + f" WHERE c.t >= {v.N_IN})")


@query("lag_model_scores", f"""
    WITH RECURSIVE {_LAGGED}, placed AS (SELECT l.*, s.split FROM lagged l JOIN splits s ON s.seq_start = l.t - {v.N_IN}), train AS (SELECT * FROM placed WHERE split = 'train'),
    {least_squares("train", _LAGS, VALUES)},
    scored AS (SELECT split, [{", ".join(VALUES)}] AS y, [{", ".join(f"{c}_lag1" for c in VALUES)}] AS last, [{", ".join(_LAGS)}] AS f FROM placed),
    fitted AS (SELECT split, y, last, list_transform(range(1, {len(VALUES) + 1}), lambda k: a[k] + list_sum(list_transform(bs, lambda x: x.b[k] * f[x.r]))) AS pred
               FROM scored, base, (SELECT list({{'r': r, 'b': b}} ORDER BY r) AS bs FROM beta))
    SELECT split, ['{"', '".join(VALUES)}'][k] AS channel, round(avg(pow(pred[k] - y[k], 2)), 6) AS mse, round(avg(pow(last[k] - y[k], 2)), 6) AS mse_persistence
    FROM fitted, range(1, {len(VALUES) + 1}) x(k) GROUP BY split, k""")
def lag_model_scores(spark, d):
    """Six lags of all channels, fitted on the training sequences, against persistence, per split and channel."""
    cube = fill_missing(v.cube_wide(spark, d).drop("time"), VALUES)
    lagged = sequences.lag_features(cube, VALUES, v.N_IN, fill=0.0).filter(F.col("t") >= v.N_IN)
    rows = join_small(lagged.withColumn("seq_start", F.col("t") - v.N_IN), known_splits(spark).drop("pos"), "seq_start", rows=v.N_SEQ)
    model = forecast.fit_lag_model(rows.filter("split = 'train'"), VALUES, v.N_IN)
    predicted = model.predict(rows)
    per_channel = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("target"), F.col(f"{c}_pred").alias("pred"),
                                               F.col(f"{c}_lag1").alias("last")) for c in VALUES))).alias("p")
    scores = forecast.score(predicted.select("split", per_channel).select("split", "p.*"),
                            {"mse_persistence": F.avg(forecast.squared_error("last"))}, by=["split", "channel"])
    return rounded(scores, ["mse", "mse_persistence"])


_NEAR_LAGS = forecast.lag_names(["v_view", "v_view_near"], 2)


@query("lag_model_neighbours", f"""
    WITH RECURSIVE shares AS (SELECT t, i + a - 1 AS i, j + b - 1 AS j, coalesce(v_view, 0) / 9 AS near, CASE WHEN a = 1 AND b = 1 THEN v_view END AS own
                              FROM cube_wide, range(3) x(a), range(3) y(b)),
    near AS (SELECT t, i, j, max(own) AS v_view, sum(near) AS v_view_near FROM shares WHERE i BETWEEN 0 AND 11 AND j BETWEEN 0 AND 23 GROUP BY t, i, j),
    lagged AS (SELECT c.*, {", ".join(f"coalesce(l{k}.{c}, 0) AS {c}_lag{k}" for c in ("v_view", "v_view_near") for k in (1, 2))} FROM near c
               LEFT JOIN near l1 ON l1.t = c.t - 1 AND l1.i = c.i AND l1.j = c.j LEFT JOIN near l2 ON l2.t = c.t - 2 AND l2.i = c.i AND l2.j = c.j WHERE c.t >= 2 AND c.v_view IS NOT NULL),
    {least_squares("lagged", _NEAR_LAGS, ["v_view"])}
    SELECT 'v_view' AS target, ['{"', '".join(_NEAR_LAGS)}'][r] AS feature, round(b[1], 6) + 0.0 AS value FROM beta UNION ALL SELECT 'v_view', 'intercept', round(a[1], 6) + 0.0 FROM base""")
def lag_model_neighbours(spark, d):
    """Coefficients of a model that also sees the surroundings of a cell."""
    cube = regrid.neighbour_features(v.cube_wide(spark, d), ["v_view"], v.N_LAT, v.N_LON)
    lagged = sequences.lag_features(cube, ["v_view", "v_view_near"], 2, fill=0.0).filter(F.col("t") >= 2)
    names = forecast.lag_names(["v_view", "v_view_near"], 2)
    return rounded(forecast.fit_linear(lagged, names, ["v_view"]).table(spark), ["value"])


@query("lag_model_normal_equations", "SELECT c.v AS target, f.v || '_lag' || k AS feature, 0.0::DOUBLE AS correlation FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in VALUES) +
       "]) AS v) c, (SELECT unnest([" + ", ".join(f"'{c}'" for c in VALUES) + "]) AS v) f, range(1, 7) r(k) WHERE EXISTS (SELECT 1 FROM cube_wide WHERE t >= 6)")
def lag_model_normal_equations(spark, d):
    """What is left of each channel after the fit correlates with no feature: that makes it the least-squares fit."""
    cube = fill_missing(v.cube_wide(spark, d).drop("time"), VALUES)
    lagged = sequences.lag_features(cube, VALUES, v.N_IN, fill=0.0).filter(F.col("t") >= v.N_IN)
    model = forecast.fit_lag_model(lagged, VALUES, v.N_IN)
    left = model.predict(lagged).withColumns({f"{c}_left": F.col(c) - F.col(f"{c}_pred") for c in VALUES})
    names = forecast.lag_names(VALUES, v.N_IN)
    every = left.agg(*(F.coalesce(F.corr(f"{c}_left", f), F.lit(0.0)).alias(f"{c}|{f}") for c in VALUES for f in names))
    rows = F.array(*(F.struct(F.lit(c).alias("target"), F.lit(f).alias("feature"), F.col(f"`{c}|{f}`").alias("correlation")) for c in VALUES for f in names))
    return rounded(every.select(F.explode(rows).alias("r")).select("r.*"), ["correlation"])


@query("rollout_lag_model", """
    WITH c AS (SELECT t, i, j, coalesce(v_view, 0) AS v FROM cube_wide), p AS (SELECT c.v AS y, l.v AS x FROM c JOIN c l ON l.t = c.t - 1 AND l.i = c.i AND l.j = c.j),
         m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM p),
         s AS (SELECT a.i::INT AS i, b.j::INT AS j, coalesce(max(c.v), 0) AS v FROM range(12) a(i) CROSS JOIN range(24) b(j) LEFT JOIN c ON c.i = a.i AND c.j = b.j AND c.t = 29 GROUP BY a.i, b.j)
    SELECT i, j, h::INT AS step, round(pow(a, h) * v + b * (1 - pow(a, h)) / (1 - a), 6) + 0.0 AS v_view FROM s, m, range(1, 11) r(h)""")
def rollout_lag_model(spark, d):
    """Ten steps of a fitted model with one lag, for every cell of the grid; missing input is 0."""
    cube = fill_missing(v.cube_wide(spark, d).select("t", "i", "j", "v_view"), ["v_view"])
    model = forecast.fit_lag_model(sequences.lag_features(cube, ["v_view"], 1).filter("v_view_lag1 IS NOT NULL"), ["v_view"], 1)
    state = forecast.last_lags(cube, ["v_view"], 1, v.N_TIME, cells=axes.grid(spark, v.N_LAT, v.N_LON))
    return rounded(forecast.rollout(state, model, 1, 10), ["v_view"])


def _weight(target: str, channel: str, lag: int) -> float:
    return (0.3 if target == channel else 0.02) / lag


_WEIGHTS = {c: [_weight(c, o, k) for o in VALUES for k in range(1, v.N_IN + 1)] for c in VALUES}
_N = v.N_IN


@query("rollout_stored", f"""
    WITH RECURSIVE {_SCALER_SQL}, p AS (SELECT {", ".join(f"max(CASE WHEN channel = '{c}' THEN m END) AS m_{c}, max(CASE WHEN channel = '{c}' THEN s END) AS s_{c}" for c in VALUES)} FROM sc),
    start AS (SELECT a.i::INT AS i, b.j::INT AS j, {", ".join(f"coalesce(max(CASE WHEN t = {v.N_TIME - k} THEN {c} END), 0) AS {c}_lag{k}" for c in VALUES for k in range(1, _N + 1))}
              FROM range(12) a(i) CROSS JOIN range(24) b(j) LEFT JOIN cube_wide c ON c.i = a.i AND c.j = b.j GROUP BY a.i, b.j),
    r(step, i, j, x) AS (
        SELECT 0, i, j, [{", ".join(f"({c}_lag{k} - m_{c}) / s_{c}" for c in VALUES for k in range(1, _N + 1))}] FROM start, p
        UNION ALL
        SELECT step + 1, i, j, {" || ".join(f"[0.01::DOUBLE + {' + '.join(f'{w!r}::DOUBLE * x[{n + 1}]' for n, w in enumerate(_WEIGHTS[c]))}] || x[{_N * q + 1}:{_N * q + _N - 1}]" for q, c in enumerate(VALUES))}
        FROM r WHERE step < 10)
    SELECT i, j, step::INT AS step, {", ".join(f"round(x[{_N * q + 1}] * s_{c} + m_{c}, 6) + 0.0 AS {c}" for q, c in enumerate(VALUES))} FROM r, p WHERE step > 0
    UNION ALL
    SELECT i, j, (1 - k)::INT, {", ".join(f"round(x[{_N * q}::BIGINT + k] * s_{c} + m_{c}, 6) + 0.0" for q, c in enumerate(VALUES))} FROM r, p, range(1, {_N + 1}) y(k) WHERE step = 0""")
def rollout_stored(spark, d):
    """A model of six lags of all channels and its scaler, stored twice and read back in its newest version, rolled out in physical units."""
    path = f"{shared_dir(spark)}/gridspark-{uuid.uuid4().hex}"
    cube = fill_missing(v.cube_wide(spark, d).drop("time"), VALUES)
    scaler = models.scaler_numbers(scaling.fit_scaler(cube, train_starts(spark), VALUES, n_starts=v.N_SEQ))
    models.save_model(spark, path, forecast.persistence(VALUES, v.N_IN), scaler)
    coefficients = np.array([_WEIGHTS[c] for c in VALUES])
    models.save_model(spark, path, forecast.LinearModel(tuple(_LAGS), tuple(VALUES), coefficients, np.full(len(VALUES), 0.01)), scaler)
    stored = models.load_model(spark, path)
    state = forecast.last_lags(cube, VALUES, v.N_IN, v.N_TIME, cells=axes.grid(spark, v.N_LAT, v.N_LON))
    return rounded(forecast.rollout_scaled(state, stored.model, stored.scaler, v.N_IN, 10), VALUES)


@query("split_files_roundtrip", "SELECT split, pos, seq_start FROM splits")
def split_files_roundtrip(spark, d):
    """The splits written and read back."""
    path = f"{shared_dir(spark)}/gridspark-{uuid.uuid4().hex}"
    split_files.write_splits(splits(spark, d), path)
    return split_files.read_written_splits(spark, path)


@query("resolve_starts", "SELECT seq_start FROM seqs WHERE seq_start IN (SELECT seq_start FROM splits WHERE split = 'test') UNION ALL SELECT seq_start + 100 FROM seqs WHERE seq_start IN (SELECT DISTINCT t FROM cube_wide)")
def resolve_starts(spark, d):
    """A given table comes before everything else; without any source all starts count (here marked by 100)."""
    given = splits(spark, d).filter("split = 'test'").select("seq_start")
    first = split_files.resolve_starts(spark, v.N_TIME, v.N_IN, v.N_OUT, starts=given)
    every = split_files.resolve_starts(spark, v.N_TIME, v.N_IN, v.N_OUT).select((F.col("seq_start") + 100).cast("int").alias("seq_start"))
    return first.unionByName(every)


@query("predictions_roundtrip", "SELECT seq_start AS sample, var AS channel, i, j, round(value::FLOAT::DOUBLE, 6) + 0.0 AS value FROM cube_long JOIN seqs ON t = seq_start + 6")
def predictions_roundtrip(spark, d):
    """The last step of every sample, written in single precision and read back."""
    path = f"{shared_dir(spark)}/gridspark-{uuid.uuid4().hex}"
    rows = sequences.make_sequences(v.cube_long(spark, d).drop("time"), v.N_IN, v.N_OUT, v.N_TIME)
    predictions.write_predictions(rows.select(F.col("seq_start").alias("sample"), F.col("var").alias("channel"), "i", "j", "step", "value"), path)
    stored = spark.read.schema("sample int, channel string, i int, j int, value float").parquet(path)
    return rounded(stored.withColumn("value", F.col("value").cast("double")), ["value"])


@query("last_predictions", "SELECT seq_start AS sample, var AS channel, i, j, value FROM cube_long JOIN seqs ON t = seq_start + 6")
def last_predictions(spark, d):
    rows = sequences.make_sequences(v.cube_long(spark, d).drop("time"), v.N_IN, v.N_OUT, v.N_TIME)
    return predictions.last_predictions(rows.select(F.col("seq_start").alias("sample"), F.col("var").alias("channel"), "i", "j", "step", "value"))


# reports on the cube ---------------------------------------------------------

@query("value_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS var, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, count({c}) AS n_valid, count(*) AS n_total, "
    f"round(count({c}) * 100.0::DOUBLE / count(*), 6) AS percent_valid FROM cube_wide" for c in VALUES))
def value_stats(spark, d):
    return rounded(quality.value_stats(v.cube_wide(spark, d), VALUES), ["mean", "std", "percent_valid"])


@query("coverage", "SELECT count(v_view) AS n_valid, 8640::BIGINT AS n_total, round(count(v_view) * 100.0::DOUBLE / 8640, 6) AS coverage FROM cube_wide")
def coverage(spark, d):
    return rounded(quality.coverage(v.cube_wide(spark, d), "v_view", v.N_LAT * v.N_LON * v.N_TIME), ["coverage"])


@query("daily_missing", "SELECT time, count(v_view) AS n_valid, count(*) AS n_total, round(100 - count(v_view) * 100.0::DOUBLE / count(*), 6) + 0.0 AS missing, "
                        "100 - count(v_view) * 100.0::DOUBLE / count(*) > 40 AS flagged FROM cube_wide GROUP BY time")
def daily_missing(spark, d):
    return rounded(quality.daily_missing(v.cube_wide(spark, d), "v_view", 40.0), ["missing"])


@query("missing_by_provenance", """
    WITH stored_days AS (SELECT DISTINCT t FROM cube_wide WHERE t % 7 < 5),
         taken AS (SELECT y.t, coalesce((SELECT max(t) FROM stored_days WHERE t <= y.t), (SELECT min(t) FROM stored_days)) AS s FROM range(30) y(t))
    SELECT (DATE '2024-01-01' + d.t::INT)::DATE AS time, s = d.t AS is_original, count(c.v_view) AS n_valid, count(*) AS n_total,
           round(100 - count(c.v_view) * 100.0::DOUBLE / count(*), 6) + 0.0 AS missing, 100 - count(c.v_view) * 100.0::DOUBLE / count(*) > 40 AS flagged
    FROM taken d JOIN cube_wide c ON c.t = s GROUP BY d.t, s""")
def missing_by_provenance(spark, d):
    """The missing share of each day of a filled cube, and whether the day is original or copied."""
    frames = v.cube_wide(spark, d).filter("t % 7 < 5").select("time", "i", "j", "v_view")
    filled = fill.fill_days(frames, v.EPOCH, v.EPOCH + timedelta(days=v.N_TIME - 1))
    return rounded(quality.daily_missing(filled, "v_view", 40.0, by=["time", "is_original"]), ["missing"])


@query("zonal_mean", "SELECT lat, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in VALUES) + " FROM cube GROUP BY lat")
def zonal_mean(spark, d):
    return rounded(quality.zonal_mean(v.with_latlon(v.cube_wide(spark, d)), VALUES), VALUES)


@query("histogram50", """
    WITH e AS (SELECT min(par) AS lo, max(par) AS hi, (max(par) - min(par)) / 50 AS w FROM ocean),
         p AS (SELECT par, lo, w, least(floor((par - lo) / w), 49)::INT AS b FROM ocean, e),
         q AS (SELECT CASE WHEN par < lo + b * w THEN b - 1 WHEN par >= lo + (b + 1) * w AND b < 49 THEN b + 1 ELSE b END AS bin FROM p)
    SELECT k::INT AS bin, round(lo + k * w, 6) + 0.0 AS left_edge, round(lo + (k + 1) * w, 6) + 0.0 AS right_edge, count(q.bin) AS n
    FROM range(50) r(k) CROSS JOIN e LEFT JOIN q ON q.bin = k GROUP BY k, lo, w""")
def histogram50(spark, d):
    return rounded(quality.histogram(v.ocean(spark, d), "par"), ["left_edge", "right_edge"])


@query("extents", "SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max, min(time) AS time_min, max(time) AS time_max, count(DISTINCT time) AS n_steps FROM cube")
def extents(spark, d):
    return quality.extents(v.with_latlon(v.cube_wide(spark, d)))


@query("check_ranges", """
    SELECT 'sst' AS rule, min(sst) AS observed_min, max(sst) AS observed_max, min(sst) > -5 AND max(sst) < 40 AS ok FROM ocean
    UNION ALL SELECT 'chla', min(chla), max(chla), min(chla) >= 0 AND max(chla) < 50 FROM ocean UNION ALL SELECT 'par', min(par), max(par), min(par) >= 0 AND max(par) < 1000 FROM ocean""")
def check_ranges(spark, d):
    rules = {"sst": (-5.0, 40.0), "chla": (0.0, 50.0), "par": (0.0, 1000.0), "windspeed": (0.0, 50.0)}
    return quality.check_ranges(v.ocean(spark, d), rules, strict_low=["sst"])


@query("reduction_ratio", "SELECT count(*) AS whole_cells, count(*) FILTER (WHERE i >= 2 AND i < 8) AS part_cells, round(count(*)::DOUBLE / count(*) FILTER (WHERE i >= 2 AND i < 8), 6) AS ratio FROM cube_wide")
def reduction_ratio(spark, d):
    from gridspark.operators.select import crop_index, reduction_ratio as ratio

    cube = v.cube_wide(spark, d)
    return rounded(ratio(cube, crop_index(cube, (2, 8), (0, v.N_LON))), ["ratio"])


@query("cube_info", f"""
    SELECT max(t) + 1 AS n_frames, max(i) + 1 AS n_lat, max(j) + 1 AS n_lon, count(*) AS n_rows, 6 AS input_len, 1 AS target_len, greatest(0, max(t) + 1 - 7 + 1) AS n_sequences,
           '{','.join(VALUES)}' AS variables FROM cube_wide""")
def cube_info(spark, d):
    return quality.cube_info(v.cube_wide(spark, d), v.N_IN, v.N_OUT)
