"""The isoprene model against numeric integration."""

import math

import numpy as np
import pytest

from gridspark.functions.isoprene import IsopreneParameters, isoprene_steps, with_isoprene


def numeric(chla, par, sst, wind, depth=1.0, ef=0.042):
    """Straight from the published formulas, the integral by Simpson's rule."""
    ct = 38.0 * chla**0.425 if chla <= 0.5 else 40.2 * chla**0.507
    kd = 4.6 / 426.3 * ct**0.547 if ct <= 13.62 else 4.6 / 912.5 * ct**0.839
    if par <= 11.425 or kd == 0:
        return 0.0
    h_max = math.log(par / 11.425) / kd
    h = np.linspace(0, min(h_max, depth), 2001)
    rate = ef * 3.6402 / ((sst + 1) ** 2 - 46.75 * (sst + 1) + 618.2) * np.log(par * np.exp(-kd * h)) ** 2
    step = h[1] - h[0]
    integral = step / 3 * (rate[0] + rate[-1] + 4 * rate[1:-1:2].sum() + 2 * rate[2:-1:2].sum())
    avg = ct / h_max
    source = 86.8798 / depth * avg * integral * 24
    sc = 2675.0 - 147.12 * sst + 3.726 * sst**2 - 0.038 * sst**3
    kw = (0.222 * wind**2 + 0.333 * wind) * (sc / 600) ** -0.5 * 0.01 * 24
    return source / (0.14 * avg**1.28 + 0.05 + kw / depth + 0.005)


CASES = [(0.5, 100.0, 20.0, 5.0), (0.51, 100.0, 20.0, 5.0), (0.2, 11.425, 20.0, 5.0), (0.2, 11.43, 20.0, 5.0), (0.2, 0.0, 20.0, 5.0),
         (0.0, 200.0, 15.0, 3.0), (2.0, 900.0, -1.5, 0.0), (30.0, 2000.0, 29.0, 12.0), (0.05, 300.0, 10.0, 7.0), (0.09, 300.0, 10.0, 7.0)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, chla double, par double, sst double, wind double")
    return [r["isoprene"] for r in with_isoprene(df, **kw).orderBy("k").collect()]


def test_every_branch(spark):
    assert run(spark, CASES) == pytest.approx([numeric(*c) for c in CASES], rel=1e-9, abs=1e-12)


def test_deep_mixed_layer(spark):
    p = IsopreneParameters(mixed_layer_depth=40.0, emission_factor=0.1)
    rows = [c for c in CASES if c[0] > 0]
    assert run(spark, rows, p=p) == pytest.approx([numeric(*c, depth=40.0, ef=0.1) for c in rows], rel=1e-8, abs=1e-12)


def test_missing_and_unreal_inputs(spark):
    nan = float("nan")
    assert run(spark, [(None, 1.0, 1.0, 1.0), (0.5, nan, 20.0, 5.0), (0.5, 100.0, None, 5.0), (0.5, 100.0, 20.0, nan),
                       (-0.1, 100.0, 20.0, 5.0), (0.5, 100.0, 70.0, 5.0)]) == [None] * 6


def test_callers_columns_survive(spark):
    df = spark.createDataFrame([(0.5, 100.0, 20.0, 5.0, "kept")], "chla double, par double, sst double, wind double, source string")
    assert with_isoprene(df).columns == ["chla", "par", "sst", "wind", "source", "isoprene"]
    assert isoprene_steps(df).first()["source"] == "kept"


def test_stays_in_generated_code(spark):
    df = spark.range(10).selectExpr("id / 3.0D as chla", "id * 20.0D as par", "id * 2.0D as sst", "id * 1.0D as wind")
    plan = with_isoprene(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
