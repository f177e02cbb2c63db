"""Regridding, block means and neighbourhoods against brute force on small grids."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridspark.operators import axes, merge, regrid, reshape, select
from gridspark.operators.axes import Axis


def axis(spark, coords):
    return Axis(spark.createDataFrame([(k, float(c)) for k, c in enumerate(coords)], "idx int, coord double"), len(coords))


def cells(spark, *fields, drop_missing=False):
    rows = [(t, i, j, None if np.isnan(f[i, j]) else float(f[i, j])) for t, f in enumerate(fields) for i in range(f.shape[0]) for j in range(f.shape[1])]
    return spark.createDataFrame([r for r in rows if not (drop_missing and r[3] is None)], "t int, i int, j int, v double")


def as_dict(df, value="v"):
    return {(r["t"], r["i"], r["j"]): r[value] for r in df.collect()}


def bracket(x, coords):
    order = np.argsort(coords)
    c = np.asarray(coords, float)[order]
    if x < c[0] or x > c[-1]:
        return []
    k = np.searchsorted(c, x)
    if c[k] == x:
        return [(order[k], 1.0)]
    f = (x - c[k - 1]) / (c[k] - c[k - 1])
    return [(order[k - 1], 1 - f), (order[k], f)]


def brute_linear(field, src, tgt):
    out = {}
    for a, x in enumerate(tgt[0]):
        for b, y in enumerate(tgt[1]):
            parts = [(p, q, wp * wq) for p, wp in bracket(x, src[0]) for q, wq in bracket(y, src[1])]
            if parts:
                value = sum(w * field[p, q] for p, q, w in parts)
                out[a, b] = None if np.isnan(value) else value
    return out


@pytest.fixture(scope="module")
def holed():
    rng = np.random.default_rng(1)
    field = rng.normal(size=(7, 9))
    field[3, 4] = np.nan
    return field


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("absent_rows", [False, True])
def test_linear_with_a_hole(spark, holed, descending, absent_rows):
    lat = np.linspace(0, 6, 7)[:: -1 if descending else 1]
    lon = np.arange(9) * 0.5
    tgt = ([-0.5, 0.0, 0.3, 2.5, 3.0, 5.9, 6.0, 6.1], [0.0, 0.25, 1.75, 2.0, 3.9, 4.0, 4.2])
    got = regrid.regrid_linear(cells(spark, holed, holed + 1, drop_missing=absent_rows), ["v"], (axis(spark, lat), axis(spark, lon)),
                               (axis(spark, tgt[0]), axis(spark, tgt[1])))
    got = as_dict(got)
    for t, field in enumerate((holed, holed + 1)):
        want = brute_linear(field, (lat, lon), tgt)
        mine = {k[1:]: x for k, x in got.items() if k[0] == t}
        # a target resting only on an absent cell has no row at all
        assert {k for k, x in want.items() if x is not None} == {k for k, x in mine.items() if x is not None}
        assert set(mine) <= set(want)
        for k, x in want.items():
            if x is not None:
                assert mine[k] == pytest.approx(x, abs=1e-12)


def test_linear_onto_own_axis_is_identity(spark, holed):
    a = (axis(spark, range(7)), axis(spark, range(9)))
    got = as_dict(regrid.regrid_linear(cells(spark, holed), ["v"], a, a))
    assert got == as_dict(cells(spark, holed))


def test_linear_keeps_a_constant(spark):
    src = (axis(spark, range(4)), axis(spark, range(4)))
    tgt = (axis(spark, [0.1, 1.7, 2.9]), axis(spark, [0.4, 2.2]))
    got = regrid.regrid_linear(cells(spark, np.full((4, 4), 3.25)), ["v"], src, tgt).collect()
    assert len(got) == 6 and all(r["v"] == pytest.approx(3.25) for r in got)


def test_nearest_midpoint_goes_down_and_outside_is_absent(spark):
    field = np.arange(12, dtype=float).reshape(3, 4)
    src = (axis(spark, [2.0, 1.0, 0.0]), axis(spark, range(4)))
    tgt = (axis(spark, [-0.1, 0.5, 1.6, 2.0]), axis(spark, [0.5, 1.5, 2.6, 3.5]))
    got = as_dict(regrid.regrid_nearest(cells(spark, field), ["v"], src, tgt))
    # latitudes run downwards: 0.5 lies between rows 2 (0.0) and 1 (1.0)
    assert got == {(0, i, j): field[p, q] for i, p in ((1, 2), (2, 0), (3, 0)) for j, q in ((0, 0), (1, 1), (2, 3))}


@pytest.mark.parametrize("boundary", ["trim", "pad"])
@pytest.mark.parametrize("given", [True, False])
def test_block_means(spark, boundary, given):
    field = np.arange(25, dtype=float).reshape(5, 5)
    field[0, 0] = np.nan
    got = as_dict(regrid.coarsen(cells(spark, field), 2, ["v"], boundary, 5 if given else None, 5 if given else None))
    n = 2 if boundary == "trim" else 3
    assert set(got) == {(0, i, j) for i in range(n) for j in range(n)}
    for (_, i, j), x in got.items():
        assert x == pytest.approx(np.nanmean(field[2 * i:2 * i + 2, 2 * j:2 * j + 2]))
    a = regrid.coarsen_axis(axis(spark, [0, 1, 2, 3, 4]), 2, boundary)
    assert [r["coord"] for r in a.table.orderBy("idx").collect()] == [0.5, 2.5, 4.0][:n] and a.size == n


def test_block_of_one_is_identity(spark, holed):
    assert as_dict(regrid.coarsen(cells(spark, holed), 1, ["v"])) == as_dict(cells(spark, holed))


def test_stencil_counts_neighbours(spark):
    ones = {(a, b): 1.0 for a in (-1, 0, 1) for b in (-1, 0, 1)}
    got = as_dict(regrid.stencil(cells(spark, np.ones((3, 3))), ["v"], ones, 3, 3))
    assert [[got[0, i, j] for j in range(3)] for i in range(3)] == [[4, 6, 4], [6, 9, 6], [4, 6, 4]]


def test_stencil_matches_padded_correlation(spark, holed):
    w = {(a, b): 0.5 * a + b + 2 for a in (-1, 0, 1) for b in (-1, 0, 1)}
    got = as_dict(regrid.stencil(cells(spark, holed), ["v"], w, 7, 9))
    padded = np.pad(np.nan_to_num(holed), 1)
    for (_, i, j), x in got.items():
        assert x == pytest.approx(sum(padded[i + 1 + a, j + 1 + b] * k for (a, b), k in w.items()))


@pytest.mark.parametrize("args,size,ends", [((20.05, 59.95, 0.1), 400, (20.05, 59.95)), ((115.05, 154.95, 0.1), 400, (115.05, 154.95)),
                                            ((20, 60, 0.25, True, None), 160, (20.125, 59.875))])
def test_regular_axes(spark, args, size, ends):
    a = axes.regular_axis(spark, *args)
    coords = [r["coord"] for r in a.table.orderBy("idx").collect()]
    assert a.size == size == len(coords) and (coords[0], coords[-1]) == ends


def test_block_factor_rounds_half_to_even(spark):
    df = spark.createDataFrame([(20.0, 5.0), (22.0, 7.0), (24.0, 9.0)], "lat double, lon double")
    assert axes.block_factor(df, "lat", "lon", 5.0).first()["factor"] == 2
    assert axes.block_factor(df, "lat", "lon", 7.0).first()["factor"] == 4


def test_conform_measures_shapes(spark):
    def stored(frame, rows, cols):
        return [(frame, a, b, float(10 * a + b)) for a in range(rows) for b in range(cols)]

    df = spark.createDataFrame(stored("ok", 2, 3) + stored("turned", 3, 2) + stored("wrong", 4, 4), "frame string, d0 int, d1 int, v double")
    out = {(r["frame"], r["i"], r["j"]): (r["shape_status"], r["v"]) for r in reshape.conform_frames(df, 2, 3).collect()}
    assert out["ok", 1, 2] == ("as_is", 12.0) and out["turned", 1, 2] == ("transposed", 21.0) and ("wrong", None, None) in out


def test_merge_keeps_the_union(spark):
    a = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 2.0)], "t int, i int, j int, a double")
    b = spark.createDataFrame([(0, 0, 1, 5.0), (0, 9, 9, 6.0)], "t int, i int, j int, b double")
    got = {(r["t"], r["i"], r["j"]): (r["a"], r["b"]) for r in merge.merge_cubes([a, b]).collect()}
    assert got == {(0, 0, 0): (1.0, None), (0, 0, 1): (2.0, 5.0), (0, 9, 9): (None, 6.0)}


def test_alignment_tolerance(spark):
    def cube(shift):
        return spark.createDataFrame([(0, 0, 20.05 + shift, 115.0), (1, 0, 20.15, 115.0)], "i int, j int, lat double, lon double").withColumn("time", F.lit("2024-01-01").cast("date"))

    report = {(r["dataset"], r["axis"]): r["n_mismatch"] for r in merge.check_alignment({"a": cube(0.0), "b": cube(1e-5), "c": cube(0.01)}).collect()}
    assert report == {("b", "lat"): 0, ("b", "lon"): 0, ("b", "time"): 0, ("c", "lat"): 1, ("c", "lon"): 0, ("c", "time"): 0}


def test_renames_only_what_is_there(spark):
    df = spark.createDataFrame([(1, 2)], "latitude int, other int")
    assert select.canonicalise(df).columns == ["lat", "other"]


def test_merge_refuses_conflicts(spark):
    a = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, float("nan"))], "t int, i int, j int, v double")
    b = spark.createDataFrame([(0, 0, 0, 5.0), (0, 0, 1, 2.0)], "t int, i int, j int, v double")
    assert [tuple(r) for r in merge.merge_conflicts([a, b]).collect()] == [(0, 0, 0, "v", 1.0, 5.0)]
    with pytest.raises(PySparkException):
        merge.merge_cubes([a, b]).collect()
    assert {(r["j"], r["v"]) for r in merge.merge_cubes([a, b.filter("j = 1")]).collect()} == {(0, 1.0), (1, 2.0)}
