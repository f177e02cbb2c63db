"""Many files as one cube: shared axes, frames of any shape, unreadable files, corrections after filling."""

import glob
import os
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridspark.functions import dates
from gridspark.operators import axes, regrid
from gridspark.operators.running import rank_distinct
from gridspark.sources import cube, daily
from gridspark.streaming import refill as r
from gridspark.streaming.ingest import ingest_incremental, read_days

SCHEMA = "time date, i int, j int, v double, delivery int"
START = date(2024, 1, 1)


@pytest.mark.parametrize("tolerance", [None, 0.5])
def test_rank_distinct(spark, tolerance):
    values = np.concatenate([np.random.default_rng(0).lognormal(3, 2, 50_000).round(3), [0.0, -7.0, -7.2, 1e9]])
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double").repartition(5)
    got = {row["x"]: row["k"] for row in rank_distinct(df, "x", "k", tolerance).collect()}
    ordered = np.unique(values)
    want = np.arange(len(ordered)) if tolerance is None else np.concatenate([[0], np.cumsum(np.diff(ordered) > tolerance)])
    assert got == dict(zip(ordered.tolist(), want.tolist()))


def test_rank_distinct_of_little(spark):
    one = spark.createDataFrame([(2.5,), (2.5,), (None,)], "x double")
    assert [tuple(x) for x in rank_distinct(one, "x", "k").collect()] == [(2.5, 0)]
    assert rank_distinct(one.limit(0), "x", "k").count() == 0


def test_the_axis_is_not_ranked_in_one_task(spark, tmp_path):
    """Only sketches and block totals meet in one partition."""
    spark.range(10_000).select((F.col("id") * 0.25).alias("x")).write.parquet(f"{tmp_path}/x")
    ranked = rank_distinct(spark.read.parquet(f"{tmp_path}/x"), "x", "k")
    ranked.collect()
    lines = ranked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    for at, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = next(x for x in lines[at + 1:] if "Aggregate" in x or "Window" in x or "Scan" in x)
            assert "Aggregate" in below


def test_sort_axis_keeps_cells(spark):
    df = spark.createDataFrame([(3.0, 9, "a"), (-1.0, 9, "b"), (3.0, 9, "c"), (0.5, 9, "d")], "lon double, j int, v string")
    assert {(x["v"], x["j"]) for x in axes.sort_axis(df, "lon", "j").collect()} == {("a", 2), ("b", 0), ("c", 2), ("d", 1)}


def test_combine_by_coords(spark):
    west = [("2024-01-01", 10.0, 1.0, 1.0), ("2024-01-01", 10.0, 2.0, None), ("2024-01-01", 11.0, 1.0, 3.0)]
    east = [("2024-01-01", 11.0 + 1e-9, 3.0, 4.0), ("2024-01-01", 10.0 - 1e-9, 2.0 + 1e-9, 5.0), ("2024-01-01", None, 2.0, 9.0)]
    df = spark.createDataFrame(west + east, "time string, lat double, lon double, v double")
    got = sorted((x["i"], x["j"], round(x["lat"], 6), round(x["lon"], 6), x["v"]) for x in cube.combine_by_coords(df, ["v"]).collect())
    assert got == [(0, 0, 10.0, 1.0, 1.0), (0, 1, 10.0, 2.0, 5.0), (1, 0, 11.0, 1.0, 3.0), (1, 2, 11.0, 3.0, 4.0)]
    apart = spark.createDataFrame(west + [("2024-01-01", 10.0, 1.0, 8.0)], df.schema)
    with pytest.raises(PySparkException, match="different values"):
        cube.combine_by_coords(apart, ["v"]).collect()


def brute_resize(frame, n_lat, n_lon):
    out = np.full((n_lat, n_lon), np.nan)
    place = lambda k, n, size: divmod(k * (n - 1), max(size - 1, 1))
    for i in range(n_lat):
        for j in range(n_lon):
            (a, x), (b, y) = place(i, frame.shape[0], n_lat), place(j, frame.shape[1], n_lon)
            x, y = x / max(n_lat - 1, 1), y / max(n_lon - 1, 1)
            rows = [(a, 1 - x)] + ([(a + 1, x)] if x else [])
            columns = [(b, 1 - y)] + ([(b + 1, y)] if y else [])
            out[i, j] = sum(p * q * frame[r, c] for r, p in rows for c, q in columns)
    return out


def test_resize_frames_of_mixed_resolutions(spark):
    rng = np.random.default_rng(3)
    shapes = {0: (5, 9), 1: (2, 2), 2: (13, 4), 3: (1, 6), 4: (5, 9), 5: (1, 1)}
    frames = {t: np.where(rng.random(s) < 0.1, np.nan, rng.normal(size=s)) for t, s in shapes.items()}
    rows = [(t, a, b, *f.shape, None if np.isnan(x) else float(x)) for t, f in frames.items() for (a, b), x in np.ndenumerate(f) if not (np.isnan(x) and t == 0)]
    out = regrid.resize_frames(spark.createDataFrame(rows, "t int, a int, b int, n0 int, n1 int, v double"), ["v"], 7, 6, ("a", "b"), ("n0", "n1"), ["t"])
    got = {(x["t"], x["i"], x["j"]): x["v"] for x in out.collect()}
    for t, f in frames.items():
        want = brute_resize(f, 7, 6)
        for (i, j), x in np.ndenumerate(want):
            have = got.get((t, i, j))
            assert have is None if np.isnan(x) else np.isclose(have, x)


def test_cut_files_become_missing_frames(spark, tmp_path):
    """A Parquet file cut in half, an empty one, one of text and one without a day; a whole one in a second file of a day."""
    schema = "d0 int, d1 int, n0 int, n1 int, v double"
    rows = spark.range(6).selectExpr("CAST(id div 3 AS INT) AS d0", "CAST(id % 3 AS INT) AS d1", "2 AS n0", "3 AS n1", "CAST(id AS DOUBLE) AS v")
    for day in ("20240101", "20240102", "20240104", "none"):
        rows.coalesce(1).write.parquet(f"{tmp_path}/x_{day}")
    path, = glob.glob(f"{tmp_path}/x_20240102/part-*")
    with open(path, "rb") as f:
        half = f.read()
    with open(path, "wb") as f:
        f.write(half[:len(half) // 2])
    os.makedirs(f"{tmp_path}/x_20240105")
    for name, content in (("x_20240105/part-0.parquet", b"no table"), ("x_20240104/part-9.parquet", b"")):
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(content)
    day = lambda p: dates.file_date(daily.folder_name(p))
    status = daily.file_status(spark, str(tmp_path), schema, day)
    assert sorted((str(x["time"]), x["status"], x["n_rows"]) for x in status.collect()) == [
        ("2024-01-01", "read", 6), ("2024-01-02", "unread", 0), ("2024-01-04", "read", 6), ("2024-01-04", "unread", 0), ("2024-01-05", "unread", 0), ("None", "undated", 6)]
    unread = daily.unread_days(status)
    assert sorted(str(x["time"]) for x in unread.collect()) == ["2024-01-02", "2024-01-05"]
    frames = daily.read_daily(spark, str(tmp_path), schema, day, tolerant=True)
    out = daily.daily_cube(frames, ["v"], START, START + timedelta(days=5), 2, 3, ("d0", "d1"), ("n0", "n1"), unread=unread)
    got = {str(x["time"])[-2:]: (x["n"], x["v"], str(x["s"])[-2:]) for x in out.groupBy("time").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.max("source_day").alias("s")).collect()}
    assert got == {"01": (6, 15.0, "01"), "02": (6, None, "02"), "03": (6, None, "02"), "04": (6, 15.0, "04"), "05": (6, None, "05"), "06": (6, None, "05")}


def test_refill_equals_filling_anew(spark, tmp_path):
    base, end = str(tmp_path), START + timedelta(days=19)

    def deliver(days, number, value):
        rows = [(START + timedelta(days=k), i, 0, value + k + i / 10, number) for k in days for i in range(3)]
        spark.createDataFrame(rows, SCHEMA).write.mode("append").partitionBy("delivery").parquet(f"{base}/src")
        ingest_incremental(spark, f"{base}/src", f"{base}/dst", f"{base}/state", SCHEMA)

    def check():
        anew = r.filled_map(r.stored_days(spark, f"{base}/dst", SCHEMA), START, end).select("time", "source_day", "is_original")
        cells = read_days(spark, f"{base}/dst", SCHEMA).withColumnRenamed("time", "source_day").join(anew, "source_day")
        have = r.read_filled(spark, f"{base}/filled", SCHEMA).select(cells.columns)
        assert sorted(map(repr, have.collect())) == sorted(map(repr, cells.collect()))
        assert have.select("time").distinct().count() == 20

    fill = lambda: [(t - START).days for t, _ in r.refill(spark, f"{base}/dst", f"{base}/filled", SCHEMA, START, end)]
    deliver([3, 4, 9, 15, 40], 1, 100)
    assert fill() == list(range(20))
    check()
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{base}/filled/time=*/*.parquet")}
    assert fill() == []
    deliver([4, 12], 2, 500)
    assert fill() == [4, 5, 6, 7, 8, 12, 13, 14]
    check()
    untouched = {p for p in before if int(p.split("time=2024-01-")[1][:2]) - 1 not in (4, 5, 6, 7, 8, 12, 13, 14)}
    assert all(os.path.getmtime(p) == before[p] for p in untouched)
    # the first frame moves: leading days are copied from it
    deliver([1], 1, 100)
    assert fill() == [0, 1, 2]
    check()
    # more rows of the same delivery
    spark.createDataFrame([(START + timedelta(days=15), 3, 0, 1.0, 1)], SCHEMA).write.mode("append").partitionBy("delivery").parquet(f"{base}/src")
    ingest_incremental(spark, f"{base}/src", f"{base}/dst", f"{base}/state", SCHEMA)
    assert fill() == [15, 16, 17, 18, 19]
    check()


def test_refill_scans_stale_sources_only(spark, tmp_path):
    days = [START + timedelta(days=k) for k in range(5)]
    spark.createDataFrame([(t, 0, 0, 1.0, 1) for t in days], SCHEMA).write.partitionBy("delivery").parquet(f"{tmp_path}/src")
    ingest_incremental(spark, f"{tmp_path}/src", f"{tmp_path}/dst", f"{tmp_path}/state", SCHEMA)
    cells = read_days(spark, f"{tmp_path}/dst", SCHEMA).filter(F.col("time").isin([days[2]]))
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == plan.count("FileScan") and "PartitionFilters: []" not in plan
    assert len(cells.inputFiles()) == 5 and cells.count() == 1
