"""Day fills and monthly fields."""

from datetime import date

import pytest
from pyspark.errors import PySparkException

from gridspark.operators import axes, fill

D = date


def frames(spark, rows):
    return spark.createDataFrame(rows, "time date, cell int, v double")


def picked(df):
    return {(r["time"].day, r["cell"]): (r["v"], r["source_day"].day, r["is_original"]) for r in df.collect()}


def test_whole_frames_are_copied_and_holes_stay(spark):
    f = frames(spark, [(D(2024, 1, 3), 0, 1.0), (D(2024, 1, 3), 1, None), (D(2024, 1, 5), 0, 2.0)])
    got = picked(fill.fill_days(f, D(2024, 1, 1), D(2024, 1, 6)))
    assert got == {(1, 0): (1.0, 3, False), (1, 1): (None, 3, False), (2, 0): (1.0, 3, False), (2, 1): (None, 3, False),
                   (3, 0): (1.0, 3, True), (3, 1): (None, 3, True), (4, 0): (1.0, 3, False), (4, 1): (None, 3, False),
                   (5, 0): (2.0, 5, True), (6, 0): (2.0, 5, False)}


def test_frames_outside_the_calendar_are_sources(spark):
    f = frames(spark, [(D(2023, 12, 20), 0, 1.0), (D(2023, 12, 30), 0, 2.0), (D(2024, 1, 9), 0, 3.0)])
    assert {k: v[0] for k, v in picked(fill.fill_days(f, D(2024, 1, 1), D(2024, 1, 2))).items()} == {(1, 0): 2.0, (2, 0): 2.0}
    late = frames(spark, [(D(2024, 2, 9), 0, 3.0), (D(2024, 2, 8), 0, 4.0)])
    assert {k: v[0] for k, v in picked(fill.fill_days(late, D(2024, 1, 1), D(2024, 1, 2))).items()} == {(1, 0): 4.0, (2, 0): 4.0}


def test_strict_leading_day_is_an_error(spark):
    f = frames(spark, [(D(2024, 1, 3), 0, 1.0)])
    with pytest.raises(PySparkException, match="no frame on or before"):
        fill.fill_days(f, D(2024, 1, 1), D(2024, 1, 6), leading="error").collect()
    assert fill.fill_days(f, D(2024, 1, 3), D(2024, 1, 6), leading="error").count() == 4


def test_fill_never_shuffles_cells(spark):
    f = frames(spark, [(D(2024, 1, 3), 0, 1.0)])
    plan = fill.fill_days(f, D(2024, 1, 1), D(2024, 1, 6))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_leap_year_calendar(spark):
    assert axes.calendar(spark, D(2024, 1, 1), D(2024, 12, 31)).count() == 366


def test_months_without_a_frame_are_missing(spark):
    m = spark.createDataFrame([(D(2024, 2, 1), 0, 1.0)], "month date, cell int, v double")
    cells = spark.createDataFrame([(0,), (1,)], "cell int")
    got = {(r["time"], r["cell"]): r["v"] for r in fill.monthly_to_daily(m, D(2024, 1, 30), D(2024, 3, 1), cells).collect()}
    assert len(got) == 2 * (2 + 29 + 1)
    assert got[D(2024, 2, 29), 0] == 1.0 and got[D(2024, 2, 29), 1] is None and got[D(2024, 1, 31), 0] is None and got[D(2024, 3, 1), 0] is None
    assert fill.monthly_to_daily(m, D(2024, 1, 30), D(2024, 3, 1)).count() == 29
