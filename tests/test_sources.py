"""Text formats, manifests, stored cubes and ingestion."""

import json
import os
from datetime import date

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridspark.functions import dates, names
from gridspark.operators import history as stopping
from gridspark.sources import cube, fixed_width, history, manifest, predictions, splits
from gridspark.sources.lines import numbered_lines
from gridspark.streaming.ingest import ingest_incremental, read_days

LAYOUT = fixed_width.TextGrid(n_lat=3, n_lon=7, per_line=3, lat0=0.0, dlat=1.0, lon0=0.0, dlon=1.0)


def slice_line(line, n):
    """The parsing rule, spelled out: strip, cut into threes, 999 for anything that is no number."""
    line, out = line.strip(), []
    for _ in range(n):
        piece, line = (line[:3], line[3:]) if len(line) >= 3 else ("", line)
        try:
            out.append(int(piece))
        except ValueError:
            out.append(999)
    return out


def brute(text, g):
    lines = text.split("\n")[g.header:]
    grid, k = {}, 0
    for i in range(g.n_lat):
        row = []
        for _ in range(g.lines_per_lat):
            row += slice_line(lines[k] if k < len(lines) else "", min(g.per_line, g.n_lon - len(row)))
            k += 1
        grid.update({(i, j): None if x == 999 else x / 10 for j, x in enumerate(row)})
    return grid


TEXTS = {
    "good": "h\nh\nh\n 275280290\n300310320\n330  lat = 1\n111222333\n444555666\n777\n123456789\n 12345678\n901",
    "short_line": "h\nh\nh\n 2752\n300310320\n330\n111222333\n44\n777\n123456789\n123\n901",
    "cut": "h\nh\nh\n 275280290\n300310320\n330\n111222",
    "letters": "h\nh\nh\n27x28 -12\n+10 5 6 7\n330\n111abc333\n444555666\n777\n123456789\n123456789\n901\nextra line",
    "odd_numbers": "h\nh\nh\n1.512. 7\n 1 -7 1e2\n0x1\n000-0100a\n444555666\n777\n123456789\n123456789\n901",
    "missing": "h\nh\nh\n" + "999999999\n999999999\n999\n" * 3,
    "headers_only": "h\nh",
    "empty": "",
    "crlf": "h\r\nh\r\nh\r\n275280290\r\n300310320\r\n330\r\n",
}


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_fixed_width_cells(spark, name):
    df = spark.createDataFrame([(name, TEXTS[name])], "path string, value string")
    got = {(r["i"], r["j"]): r["value"] for r in fixed_width.parse_text_grid(df, LAYOUT).collect()}
    assert got == brute(TEXTS[name], LAYOUT)


def test_ozone_layout_from_files(spark, tmp_path):
    g = fixed_width.TextGrid()
    body = []
    for i in range(g.n_lat):
        row = [f"{(i * 7 + j * 3) % 1000:3d}" for j in range(g.n_lon)]
        chunks = [row[a:a + 25] for a in range(0, g.n_lon, 25)]
        body += [" " + "".join(c) for c in chunks[:-1]] + [" " + "".join(chunks[-1]) + f"   lat = {-59.5 + i:6.1f}"]
    text = "title\nlongitudes\nlatitudes\n" + "\n".join(body) + "\n"
    (tmp_path / "01.txt").write_text(text)
    (tmp_path / "02.txt").write_text(text[: len(text) // 2])
    out = fixed_width.read_fixed_width_grid(spark, str(tmp_path)).withColumn("name", dates.base_name("path"))
    rows = out.collect()
    assert len(rows) == 2 * 120 * 288
    for name, source in (("01.txt", text), ("02.txt", text[: len(text) // 2])):
        want = brute(source, g)
        assert all(r["value"] == want[r["i"], r["j"]] for r in rows if r["name"] == name)
    corner = out.filter("name = '01.txt' and i = 119 and j = 287").first()
    assert (corner["lat"], corner["lon"]) == (59.5, 179.375)
    months = out.select("name").distinct().select(dates.month_number_date("name", 2018).alias("d")).collect()
    assert {r["d"] for r in months} == {date(2018, 1, 15), date(2018, 2, 15)}


def test_diagnosis(spark):
    long = " " + "275" * 80
    text = f"one\ntwo\nthree\nfour\n{long}\n 276  lat = -12.5  \n"
    df = spark.createDataFrame([("a", text), ("b", "x\ny"), ("c", "")], "path string, value string")
    r = {x["path"]: x for x in fixed_width.diagnose_text(df).collect()}
    a = r["a"]
    assert (a["n_lines"], a["data_start"], a["lat_label"]) == (6, 5, -12.5)
    assert (a["line_lengths"], a["digit_counts"], a["leading_blanks"]) == ([241, 17], [240, 6], [True, True])
    assert a["sample_values"] == [275] * 10 and a["head"] == ["one", "two", "three", "four", long]
    assert (r["b"]["n_lines"], r["b"]["data_start"], r["b"]["line_lengths"]) == (2, 4, []) and r["c"]["n_lines"] == 0


@pytest.mark.parametrize("name,want", [
    ("GC1SG1_20180121D01D_L2MG_CHLA.nc", date(2018, 1, 21)), ("OMI_2018m0131_v003.nc4", date(2018, 1, 31)), ("x_2018_03_05.nc", date(2018, 3, 5)),
    ("x_20181399.nc", None), ("x_20180102030405.nc", date(2018, 1, 2)), ("readme.txt", None), ("x_2018m1301.nc", None)])
def test_file_dates(spark, name, want):
    assert spark.range(1).select(dates.file_date(F.lit(name)).alias("d")).first()["d"] == want


def test_file_date_falls_back_to_modification_time(spark):
    df = spark.createDataFrame([("readme.txt",)], "n string").withColumn("m", F.lit("2020-02-03 04:05:06").cast("timestamp"))
    assert df.select(dates.file_date("n", "m").alias("d")).first()["d"] == date(2020, 2, 3)


def test_strict_product_date(spark):
    suffix = "_L2MG_SST[ND]Q_SST"
    rows = [("GC1SG1_2018012100" + suffix + ".nc", date(2018, 1, 21)), ("xGC1SG1_2018012100" + suffix + ".nc", None),
            ("GC1SG1_20180121" + suffix + ".nc", None), ("GC1SG1_2018012100_L2MG_SSTNQ_SST.nc", None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "n string")
    got = {r["n"]: r["d"] for r in df.select("n", dates.product_date("n", suffix).alias("d")).collect()}
    assert got == dict(rows)


def test_listing_and_validity(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "SST").coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "b"))
    (tmp_path / "broken.parquet").write_text("no parquet")
    files = manifest.list_files(spark, str(tmp_path), "*.parquet")
    checked = manifest.validate_files(files, "SST")
    assert sorted((r["readable"], r["has_variable"]) for r in checked.collect()) == [(False, False), (True, False), (True, True)]
    rate = manifest.validity_rate(checked, 4).first()
    assert (rate["n_valid"], rate["n_files"], rate["percent"]) == (1, 3, 25.0)


def test_index_files(spark, tmp_path):
    for name, text in (("train", "5\n\n 3 \n1\n"), ("val", "0\n"), ("test", "2\n4")):
        (tmp_path / f"{name}_indices.txt").write_text(text)
    got = splits.read_splits(spark, str(tmp_path))
    assert [tuple(r) for r in got.filter("split = 'train'").orderBy("pos").collect()] == [("train", 0, 5), ("train", 1, 3), ("train", 2, 1)]
    splits.write_splits(got, str(tmp_path / "p"))
    assert sorted(map(tuple, splits.read_written_splits(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, got.collect()))
    info = splits.split_info(got, "cube", 6, 1, 6, (0.5, 0.2, 0.3), 42)
    splits.write_split_info(info, str(tmp_path / "info"))
    back = splits.read_split_info(spark, str(tmp_path / "info")).first()
    assert back["splits"] == {"train": 3, "val": 1, "test": 2} and (back["train_end"], back["val_end"]) == (3, 4)
    with pytest.raises(PySparkException):
        splits.read_split(spark, str(tmp_path), "none").count()
    resolve = lambda **kw: sorted(r["seq_start"] for r in splits.resolve_starts(spark, 12, 6, 1, **kw).collect())
    folder = str(tmp_path)
    assert resolve() == [0, 1, 2, 3, 4, 5] and resolve(folder=folder, split="test") == [2, 4]
    assert resolve(index_file=f"{folder}/val_indices.txt", folder=folder, split="test") == [0]
    assert resolve(starts=spark.createDataFrame([(1,)], "seq_start int"), folder=folder, split="test") == [1]


def test_pretty_printed_history(spark, tmp_path):
    record = {"train_losses": [0.75, 0.58], "val_losses": [0.64, 0.52], "metrics_history": [{"val_loss": 0.64}, {"val_loss": 0.52, "mae": 0.1}],
              "current_epoch": 2, "best_metric": 0.52}
    (tmp_path / "h.json").write_text(json.dumps(record, indent=4))
    got = {(r["epoch"], r["metric"]): r["value"] for r in history.read_history(spark, str(tmp_path / "h.json")).collect()}
    assert got == {(1, "train_loss"): 0.75, (2, "train_loss"): 0.58, (1, "val_loss"): 0.64, (2, "val_loss"): 0.52, (2, "mae"): 0.1}


LOG = """2024-03-09 07:15:34,021 - trainer - INFO - Starting training for 100 epochs...
2024-03-09 07:15:51,560 - trainer - INFO - Epoch 1 / 100 - Train Loss: 0.6120 - val_loss: 0.4118
2024-03-09 07:15:51,569 - trainer - INFO - \x1b[92mNew best model saved with metric: {'val_loss': 0.4118251900341}\x1b[0m
2024-03-10 00:00:00,001 - trainer - INFO - Epoch 2 / 100 - Train Loss: 0.4021 - val_loss: 0.4303
2024-03-10 00:00:08,815 - trainer - INFO - Epoch 3 / 100 - Train Loss: nan - val_loss: 0.3908
2024-03-10 00:00:08,815 - trainer - INFO - \x1b[92mNew best model saved with metric: {'val_loss': 0.3907714400125}\x1b[0m
2024-03-10 00:00:09,000 - trainer - INFO - Early stopping triggered at epoch 3.
2024-03-10 00:00:09,001 - trainer - INFO - Training completed in 47.50 seconds.
"""


def test_run_logs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "trainer_1.log").write_text(LOG)
    (tmp_path / "trainer_2.log").write_text("2024-03-09 07:15:34,021 - trainer - INFO - Starting training for 100 epochs...\nTraceback\n")
    rows = history.read_run_logs(spark, str(tmp_path)).orderBy("epoch").collect()
    assert [(r["run"], r["epoch"], r["epochs"], r["val_loss"], r["best_metric"]) for r in rows] == [
        ("sub/trainer_1.log", 1, 100, 0.4118, 0.4118251900341), ("sub/trainer_1.log", 2, 100, 0.4303, None), ("sub/trainer_1.log", 3, 100, 0.3908, 0.3907714400125)]
    events = history.parse_log_lines(spark.read.text(str(tmp_path / "sub")).withColumn("run", F.lit("a")))
    assert {r["kind"]: (r["epoch"], r["value"]) for r in events.filter("kind in ('stopped', 'completed')").collect()} == {"stopped": (3, None), "completed": (None, 47.50)}
    marked = stopping.early_stopping(spark.createDataFrame([tuple(r[c] for c in ("run", "epoch", "val_loss")) for r in rows], "run string, epoch int, metric double"))
    assert [r["epoch"] for r in marked.filter("is_best").orderBy("epoch").collect()] == [1, 3]


def test_cube_storage_prunes(spark, tmp_path):
    rows = [(date(2024, m, 3), m, 0, 0, 20.0, 115.0, float(m), None) for m in (1, 2)]
    df = spark.createDataFrame(rows, "time date, t int, i int, j int, lat double, lon double, a double, b double")
    path = str(tmp_path / "cube")
    cube.write_cube(df, path)
    assert sorted(p.name for p in (tmp_path / "cube").iterdir() if p.is_dir()) == ["month=2024-01", "month=2024-02"]
    back = cube.read_cube(spark, path, ["a"])
    assert sorted(r["a"] for r in back.collect()) == [1.0, 2.0]
    plan = back.filter("i < 3")._jdf.queryExecution().executedPlan().toString()
    assert "b:float" not in plan and "LessThan(i,3)" in plan
    cube.write_attributes(spark, {"title": "x"}, str(tmp_path / "attributes"))
    assert spark.read.schema("attributes map<string,string>").json(str(tmp_path / "attributes")).first()[0] == {"title": "x"}


def test_predictions_keep_the_last_step(spark, tmp_path):
    df = spark.createDataFrame([(0, s, "c", 0, 0, float(s)) for s in range(3)], "sample int, step int, channel string, i int, j int, value double")
    predictions.write_predictions(df, str(tmp_path / "p"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect()] == [(0, "c", 0, 0, 2.0)]


def test_ingest_replaces_late_days(spark, tmp_path):
    src, dst, state = (str(tmp_path / x) for x in ("src", "dst", "state"))
    schema = "time date, i int, j int, v double, delivery int"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(src)

    d1, d2, d3 = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)
    arrive((d1, 0, 0, 1.0, 1), (d1, 0, 1, 2.0, 1), (d2, 0, 0, 3.0, 1))
    ingest_incremental(spark, src, dst, state, schema)
    arrive((d2, 0, 0, 30.0, 2))
    arrive((d3, 0, 0, 5.0, 1))
    arrive((d2, 0, 1, 31.0, 2))
    ingest_incremental(spark, src, dst, state, schema, max_files=1)
    ingest_incremental(spark, src, dst, state, schema)
    got = sorted((r["time"], r["j"], r["v"]) for r in read_days(spark, dst, schema).collect())
    assert got == [(d1, 0, 1.0), (d1, 1, 2.0), (d2, 0, 30.0), (d2, 1, 31.0), (d3, 0, 5.0)]


def test_ingest_keeps_a_day_in_many_files(spark, tmp_path):
    src, dst, state = (str(tmp_path / x) for x in ("src", "dst", "state"))
    schema = "time date, i int, j int, v double, delivery int"
    day = spark.range(1000).selectExpr("date'2024-01-01' AS time", "cast(id AS int) AS i", "0 AS j", "cast(id AS double) AS v", "7 AS delivery")
    day.repartition(4).write.parquet(src)
    for max_files in (1, None):
        ingest_incremental(spark, src, dst, state, schema, max_files=max_files)
        assert read_days(spark, dst, schema).count() == 1000


def test_clean_path(spark):
    assert spark.range(1).select(names.clean_path(F.lit("SST[ND]Q[x].nc")).alias("p")).first()["p"] == "SST_ND_Q_x_.nc"


def test_lines_are_numbered_whatever_the_pieces(spark, tmp_path):
    """Two files cut into many pieces of bytes, with blank lines, lines of all lengths and none at the end."""
    rng = np.random.default_rng(1)
    texts = {"a": ["x" * int(n) for n in rng.integers(0, 90, 700)], "b/c": ["", "", "one", ""]}
    for name, lines in texts.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "w", newline="") as f:
            f.write("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = numbered_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 20
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # the end of a last empty line is no line
    want = {name: lines[:-1] if lines[-1] == "" else lines for name, lines in texts.items()}
    for name, lines in want.items():
        assert [r["value"] for r in sorted((r for r in rows if r["path"].endswith(name)), key=lambda r: r["line"])] == lines
        assert sorted(r["line"] for r in rows if r["path"].endswith(name)) == list(range(len(lines)))


def test_grids_in_a_row_equal_grids_alone(spark, tmp_path):
    layout = fixed_width.TextGrid(header=2, n_lat=4, n_lon=7, per_line=3, lat0=0.0, dlat=1.0, lon0=0.0, dlon=1.0)
    rng = np.random.default_rng(2)
    grid = lambda: "\n".join(["h", "h"] + ["  " + "".join(f"{n:3d}" for n in rng.integers(100, 1000, 3 if k % 3 < 2 else 1)) + "  \r" for k in range(12)])
    grids = [grid() for _ in range(40)]
    with open(f"{tmp_path}/all.txt", "w", newline="") as f:
        f.write("\n".join(grids) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = sorted(map(tuple, fixed_width.read_grids(spark, str(tmp_path), layout).drop("path").collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    alone = fixed_width.parse_text_grid(spark.createDataFrame(list(enumerate(grids)), "grid int, value string"), layout, keys=["grid"])
    assert got == sorted(map(tuple, alone.collect()), key=repr)
