"""Projections, crops, shapes, grids."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridspark.functions import dates, geo, missing
from gridspark.operators import axes, fill, merge, quality, regrid, reshape, select
from gridspark.plans import analysis, views as v
from gridspark.plans.registry import query
from gridspark.session import shared_dir

VALUES = list(v.CHANNELS)
_COLS = ", ".join(VALUES)
_ROUNDED = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in VALUES)
_AVGS = ", ".join(f"round(avg({c}), 6) + 0.0 AS {c}" for c in VALUES)


def rounded(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: v.r6(c) for c in columns})


def cube(spark, d) -> DataFrame:
    return v.with_latlon(v.cube_wide(spark, d))


def index_axis(spark, n: int, numerator: int = 1, denominator: int = 1) -> axes.Axis:
    """Positions k * numerator / denominator."""
    k = F.col("id")
    return axes.Axis(spark.range(n).select(k.cast("int").alias("idx"), (k * numerator / denominator).cast("double").alias("coord")), n)


@query("zonal_block_mean", f"""
    SELECT time, (i // 2)::INT AS i, {_AVGS} FROM
      (SELECT time, i // 2 * 2 AS i, j // 2 AS bj, {', '.join(f'avg({c}) AS {c}' for c in VALUES)} FROM cube
       WHERE lat BETWEEN 20.05 AND 20.85 AND i < 12 AND j < 24 GROUP BY time, i // 2, j // 2, i // 2 * 2)
    GROUP BY time, i // 2""")
def zonal_block_mean(spark, d):
    box = select.crop_bbox(cube(spark, d), 20.05, 20.85, 115.05, 117.35)
    blocks = regrid.coarsen(box, 2, VALUES, n_lat=v.N_LAT, n_lon=v.N_LON, frame=["time"])
    return rounded(quality.zonal_mean(blocks, VALUES, by=["time", "i"]), VALUES)


@query("crop_bbox", f"SELECT time, t, i, j, lat, lon, {_COLS} FROM cube WHERE lat BETWEEN 20.25 AND 20.85 AND lon BETWEEN 115.05 AND 115.55")
def crop_bbox(spark, d):
    return select.crop_bbox(cube(spark, d), 20.25, 20.85, 115.05, 115.55)


@query("crop_index", f"SELECT time, t, i, j, {_COLS} FROM cube_wide WHERE i >= 2 AND i < 8 AND j >= 0 AND j < 6")
def crop_index(spark, d):
    return select.crop_index(v.cube_wide(spark, d), (2, 8), (0, 6))


@query("time_slice", f"SELECT time, t, i, j, {_COLS} FROM cube_wide WHERE t >= 4 AND t < 11")
def time_slice(spark, d):
    return select.time_slice(v.cube_wide(spark, d), 4, 7)


@query("first_step", f"SELECT time, t, i, j, {_COLS} FROM cube_wide WHERE t = (SELECT min(t) FROM cube_wide)")
def first_step(spark, d):
    return select.first_step(v.cube_wide(spark, d))


@query("last_step", f"SELECT time, t, i, j, {_COLS} FROM cube_wide WHERE t = (SELECT max(t) FROM cube_wide)")
def last_step(spark, d):
    return select.last_step(v.cube_wide(spark, d))


@query("select_vars", "SELECT time, t, i, j, lat, lon, v_view, v_error FROM cube")
def select_vars(spark, d):
    return select.select_vars(cube(spark, d), ["v_view", "v_error"])


@query("canonical_names", "SELECT time, lat, lon, v_view AS windspeed FROM cube")
def canonical_names(spark, d):
    raw = cube(spark, d).select(F.col("time").alias("valid_time"), F.col("lat").alias("Latitude"), F.col("lon").alias("longitude"), F.col("v_view").alias("si10"))
    return select.canonicalise(raw)


@query("optional_vars", "SELECT time, i, j, v_view, NULL::DOUBLE AS cloud_fraction FROM cube_wide")
def optional_vars(spark, d):
    return select.with_optional(v.cube_wide(spark, d).select("time", "i", "j", "v_view"), {"v_view": "double", "cloud_fraction": "double"})


@query("wrap_lon", "SELECT time, i, j, round(115.05 + 7.5 * j + 180 - 360 * floor((115.05 + 7.5 * j + 180) / 360) - 180, 6)::DOUBLE + 0.0 AS lon FROM cube_wide")
def wrap_lon(spark, d):
    return v.cube_wide(spark, d).select("time", "i", "j", v.r6(geo.wrap_lon(F.lit(115.05) + F.col("j") * F.lit(7.5))).alias("lon"))


@query("sort_axis", """
    SELECT time, i, lon, (dense_rank() OVER (ORDER BY lon) - 1)::INT AS j, v_view FROM
      (SELECT time, i, v_view, (115.05 + 7.5 * j + 180 - 360 * floor((115.05 + 7.5 * j + 180) / 360) - 180)::DECIMAL(9,2)::DOUBLE AS lon FROM cube_wide)""")
def sort_axis(spark, d):
    wrapped = v.cube_wide(spark, d).select("time", "i", "j", "v_view", F.round(geo.wrap_lon(F.lit(115.05) + F.col("j") * F.lit(7.5)), 2).alias("lon"))
    return axes.sort_axis(wrapped, "lon", "j")


@query("decode_packed", "SELECT o_orderkey, round(o_custkey * 0.0012::DOUBLE - 10, 6) + 0.0 AS value FROM orders")
def decode_packed(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", v.r6(missing.decode_packed("o_custkey", 0.0012, -10.0)).alias("value"))


@query("null_if", "SELECT o_orderkey, nullif(value, -9999.0) AS value FROM flagged")
def null_if(spark, d):
    return v.flagged(spark, d).select("o_orderkey", missing.null_if("value", [-9999.0, 999.0]).alias("value"))


@query("mask_quality", "SELECT o_orderkey, CASE WHEN flag = 0 THEN value END AS value, flag FROM flagged")
def mask_quality(spark, d):
    return missing.mask_quality(v.flagged(spark, d), "value", "flag")


@query("fill_missing", "SELECT time, i, j, " + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in VALUES) + " FROM cube_wide")
def fill_missing(spark, d):
    return missing.fill_missing(v.cube_wide(spark, d).drop("t"), VALUES)


@query("normalise_missing", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN value = -9999 THEN NULL ELSE value END AS value FROM flagged")
def normalise_missing(spark, d):
    with_nan = v.flagged(spark, d).select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return missing.normalise(with_nan, ["value"], [-9999.0])


@query("float32", "SELECT time, i, j, " + ", ".join(f"round({c}::FLOAT::DOUBLE, 6) + 0.0 AS {c}" for c in VALUES) + " FROM cube_wide")
def float32(spark, d):
    low = select.to_float32(v.cube_wide(spark, d).select("time", "i", "j", *VALUES))
    return rounded(low.withColumns({c: F.col(c).cast("double") for c in VALUES}), VALUES)


# frames stored as they are, transposed, and with a wrong shape
@query("conform_frames", """
    SELECT t, CASE t % 3 WHEN 0 THEN 'as_is' WHEN 1 THEN 'transposed' ELSE 'bad' END AS shape_status,
           CASE WHEN t % 3 < 2 THEN i END AS i, CASE WHEN t % 3 < 2 THEN j END AS j, CASE WHEN t % 3 < 2 THEN v_view END AS v_view FROM cube_wide""")
def conform_frames(spark, d):
    kind = F.col("t") % 3
    stored = v.cube_wide(spark, d).select(
        "t", F.when(kind == 1, F.col("j")).otherwise(F.col("i")).alias("d0"), F.when(kind == 1, F.col("i")).otherwise(F.col("j")).alias("d1"),
        F.when(kind == 0, v.N_LAT).when(kind == 1, v.N_LON).otherwise(10).alias("rows"),
        F.when(kind == 1, v.N_LAT).otherwise(v.N_LON).alias("cols"), "v_view")
    out = reshape.conform_frames(stored, v.N_LAT, v.N_LON, frame="t", shape=["rows", "cols"])
    return out.select("t", "shape_status", "i", "j", F.when(F.col("shape_status") != "bad", F.col("v_view")).alias("v_view"))


@query("squeeze_frames", "SELECT t, 'squeezed' AS shape_status, i, j, v_view FROM cube_wide")
def squeeze_frames(spark, d):
    leading = F.col("t") % 2 == 0
    stored = v.cube_wide(spark, d).select(
        "t", F.when(leading, F.lit(0)).otherwise(F.col("i")).alias("d0"), F.when(leading, F.col("i")).otherwise(F.col("j")).alias("d1"),
        F.when(leading, F.col("j")).otherwise(F.lit(0)).alias("d2"), F.when(leading, 1).otherwise(v.N_LAT).alias("a"),
        F.when(leading, v.N_LAT).otherwise(v.N_LON).alias("b"), F.when(leading, v.N_LON).otherwise(1).alias("c"), "v_view")
    return reshape.conform_frames(stored, v.N_LAT, v.N_LON, frame="t", dims=["d0", "d1", "d2"], shape=["a", "b", "c"]).select("t", "shape_status", "i", "j", "v_view")


@query("to_wide", f"SELECT time, t, i, j, {_COLS} FROM cube_wide")
def to_wide(spark, d):
    return reshape.to_wide(v.cube_long(spark, d), v.EVENT_TYPES, ["time", "t", "i", "j"], prefix="v_")


@query("to_long", "SELECT time, t, i, j, 'v_' || var AS var, value FROM cube_long")
def to_long(spark, d):
    return reshape.to_long(v.cube_wide(spark, d), VALUES)


@query("channel_arrays", f"SELECT time, i, j, {_COLS} FROM cube_wide")
def channel_arrays(spark, d):
    return reshape.from_arrays(reshape.to_arrays(v.cube_wide(spark, d).drop("t"), VALUES), VALUES)


@query("apply_cells", "SELECT l_orderkey, l_linenumber, round(sqrt(par * par + sst * sst), 6) + 0.0 AS norm FROM ocean")
def apply_cells(spark, d):
    def norm(a: pd.Series, b: pd.Series) -> pd.Series:
        return np.sqrt(a * a + b * b)

    out = select.apply_cells(v.ocean(spark, d), norm, ["par", "sst"], "norm")
    return rounded(out.select("l_orderkey", "l_linenumber", "norm"), ["norm"])


@query("regular_axis", """
    SELECT k::INT AS idx, round(20.05 + 0.1 * k, 2)::DOUBLE AS coord, count(c.i) AS n_cells
    FROM (SELECT unnest(range(12)) AS k) LEFT JOIN cube_wide c ON c.i = k GROUP BY k""")
def regular_axis(spark, d):
    axis = axes.regular_axis(spark, 20.05, 21.15, 0.1)
    counts = v.with_latlon(v.cube_wide(spark, d)).groupBy("lat").agg(F.count("i").alias("n"))
    return axis.table.join(counts, F.col("coord") == F.col("lat"), "left").select("idx", "coord", F.coalesce("n", F.lit(0).cast("long")).alias("n_cells"))


@query("block_factor", """
    SELECT round_even(0.5::DOUBLE / min(step), 0)::INT AS factor
    FROM (SELECT max(c) - min(c) AS step FROM (SELECT 'lat' AS a, lat AS c, dense_rank() OVER (ORDER BY lat) AS k FROM cube
                                               UNION ALL SELECT 'lon', lon, dense_rank() OVER (ORDER BY lon) FROM cube) WHERE k <= 2 GROUP BY a)""")
def block_factor(spark, d):
    return axes.block_factor(cube(spark, d), "lat", "lon", 0.5)


@query("densify", f"""
    SELECT g.t, g.i, g.j, {_COLS} FROM (SELECT t::INT AS t, i::INT AS i, j::INT AS j FROM range(30) a(t), range(12) b(i), range(24) c(j)) g
    LEFT JOIN cube_wide USING (t, i, j)""")
def densify(spark, d):
    return axes.densify(v.cube_wide(spark, d).drop("time"), v.N_LAT, v.N_LON, v.N_TIME)


def _coarsen_sql(where: str) -> str:
    block_coordinate = "(SELECT avg(round({lo} + 0.1 * k, 2)) FROM range({n}) r(k) WHERE k // 5 = b.{axis})"
    return f"""SELECT b.*, round({block_coordinate.format(lo=20.05, n=12 if not where else 10, axis='i')}, 6)::DOUBLE AS lat,
               round({block_coordinate.format(lo=115.05, n=24 if not where else 20, axis='j')}, 6)::DOUBLE AS lon
               FROM (SELECT t, (i // 5)::INT AS i, (j // 5)::INT AS j, {_AVGS} FROM cube_wide {where} GROUP BY t, i // 5, j // 5) b"""


def _coarsen(spark, d, boundary):
    out = regrid.coarsen(v.cube_wide(spark, d), 5, VALUES, boundary, v.N_LAT, v.N_LON)
    lat = regrid.coarsen_axis(axes.regular_axis(spark, 20.05, 21.15, 0.1), 5, boundary)
    lon = regrid.coarsen_axis(axes.regular_axis(spark, 115.05, 117.35, 0.1), 5, boundary)
    return rounded(axes.with_coordinates(out, lat, lon), [*VALUES, "lat", "lon"])


@query("coarsen_trim", _coarsen_sql("WHERE i < 10 AND j < 20"))
def coarsen_trim(spark, d):
    return _coarsen(spark, d, "trim")


@query("coarsen_pad", _coarsen_sql(""))
def coarsen_pad(spark, d):
    return _coarsen(spark, d, "pad")


_WEIGHTS_SQL = """SELECT tgt, lo AS src, 1 - f AS w, CASE WHEN f = 0 THEN 1 ELSE 2 END AS need FROM pos WHERE lo + CASE WHEN f = 0 THEN 0 ELSE 1 END <= {last}
    UNION ALL SELECT tgt, lo + 1, f, 2 FROM pos WHERE f > 0 AND lo + 1 <= {last}"""


@query("regrid_linear", f"""
    WITH pos AS (SELECT k AS tgt, 2 * k // 5 AS lo, (2 * k % 5)::DOUBLE / 5 AS f FROM range(58) r(k)),
         lat_w AS ({_WEIGHTS_SQL.format(last=11)}), lon_w AS ({_WEIGHTS_SQL.format(last=23)})
    SELECT c.t, a.tgt::INT AS i, b.tgt::INT AS j, round(a.tgt * 2.0 / 5, 6)::DOUBLE AS lat, round(b.tgt * 2.0 / 5, 6)::DOUBLE AS lon,
           {", ".join(f"CASE WHEN count({c}) = max(a.need * b.need) THEN round(sum(a.w * b.w * {c}), 6) + 0.0 END AS {c}" for c in VALUES)}
    FROM cube_wide c JOIN lat_w a ON c.i = a.src JOIN lon_w b ON c.j = b.src GROUP BY c.t, a.tgt, b.tgt""")
def regrid_linear(spark, d):
    out = regrid.regrid_linear(v.cube_wide(spark, d), VALUES, (index_axis(spark, v.N_LAT), index_axis(spark, v.N_LON)),
                               (index_axis(spark, 30, 2, 5), index_axis(spark, 58, 2, 5)))
    return rounded(out, [*VALUES, "lat", "lon"])


@query("regrid_nearest", f"""
    SELECT c.t, a.k::INT AS i, b.k::INT AS j, a.k / 2.0::DOUBLE AS lat, b.k / 2.0::DOUBLE AS lon, {_COLS} FROM cube_wide c
    JOIN (SELECT k FROM range(24) r(k) WHERE k <= 22) a ON c.i = a.k // 2 JOIN (SELECT k FROM range(47) r(k)) b ON c.j = b.k // 2""")
def regrid_nearest(spark, d):
    return regrid.regrid_nearest(v.cube_wide(spark, d), VALUES, (index_axis(spark, v.N_LAT), index_axis(spark, v.N_LON)),
                                 (index_axis(spark, 24, 2, 4), index_axis(spark, 47, 2, 4)))


KERNEL = {(di, dj): 1.0 + 0.1 * (3 * (di + 1) + dj + 1) for di in (-1, 0, 1) for dj in (-1, 0, 1)}


@query("stencil3x3", """
    SELECT t, (i - di)::INT AS i, (j - dj)::INT AS j, """ + ", ".join(f"round(sum(coalesce({c}, 0) * (1 + 0.1::DOUBLE * (3 * (di + 1) + dj + 1))), 6) + 0.0 AS {c}" for c in VALUES) + """
    FROM cube_wide, (SELECT unnest([-1, 0, 1]) AS di), (SELECT unnest([-1, 0, 1]) AS dj)
    WHERE i - di BETWEEN 0 AND 11 AND j - dj BETWEEN 0 AND 23 GROUP BY t, i - di, j - dj""")
def stencil3x3(spark, d):
    return rounded(regrid.stencil(v.cube_wide(spark, d), VALUES, KERNEL, v.N_LAT, v.N_LON), VALUES)


_KERNEL = {(a, b): 1 / (1 + abs(a) + abs(b)) for a in range(-3, 4) for b in range(-3, 4)}


@query("stencil7x7", """
    SELECT c.t, (c.i + a)::INT AS i, (c.j + b)::INT AS j, """ + ", ".join(f"round(sum(coalesce({c}, 0) / (1.0::DOUBLE + abs(a) + abs(b))), 6) + 0.0 AS {c}" for c in VALUES) + """
    FROM cube_wide c, range(-3, 4) x(a), range(-3, 4) y(b) WHERE c.i + a BETWEEN 0 AND 11 AND c.j + b BETWEEN 0 AND 23 GROUP BY 1, 2, 3""")
def stencil7x7(spark, d):
    """A wide kernel over tiles with halos."""
    return rounded(regrid.stencil_tiles(v.cube_wide(spark, d).select("t", "i", "j", *VALUES), VALUES, _KERNEL, v.N_LAT, v.N_LON, tile=8), VALUES)


@query("neighbour_features", """
    WITH near AS (SELECT t, (i - di)::INT AS i, (j - dj)::INT AS j, sum(coalesce(v_view, 0)) / 9 AS m FROM cube_wide, (SELECT unnest([-1, 0, 1]) AS di), (SELECT unnest([-1, 0, 1]) AS dj)
                  WHERE i - di BETWEEN 0 AND 11 AND j - dj BETWEEN 0 AND 23 GROUP BY t, i - di, j - dj)
    SELECT n.t, n.i, n.j, c.v_view, round(n.m, 6) AS v_view_near FROM near n LEFT JOIN cube_wide c USING (t, i, j)""")
def neighbour_features(spark, d):
    return rounded(regrid.neighbour_features(v.cube_wide(spark, d), ["v_view"], v.N_LAT, v.N_LON), ["v_view_near"])


@query("merge_cubes", f"SELECT t, i, j, {_COLS} FROM cube_wide")
def merge_cubes(spark, d):
    """A product per variable, stored in one pass, and merged."""
    base = f"{shared_dir(spark)}/gridspark-{uuid.uuid4().hex}"
    v.cube_long(spark, d).select("t", "i", "j", "var", "value").write.partitionBy("var").parquet(base)
    stored = spark.read.schema("t int, i int, j int, value double, var string").parquet(base)
    return merge.merge_cubes([stored.filter(F.col("var") == e).select("t", "i", "j", F.col("value").alias(f"v_{e}")) for e in v.EVENT_TYPES])


@query("merge_conflicts", """
    WITH x AS (SELECT t, i, j, v_view, v_click FROM cube_wide), y AS (SELECT t, i, j, v_view + CASE WHEN t % 7 = 2 THEN 1 ELSE 0 END AS v_view, v_click FROM cube_wide)
    SELECT x.t, x.i, x.j, 'v_view' AS variable, x.v_view AS lowest, y.v_view AS highest FROM x JOIN y USING (t, i, j) WHERE x.v_view <> y.v_view""")
def merge_conflicts(spark, d):
    """Two cubes that disagree in one variable on some days."""
    cube = v.cube_wide(spark, d).select("t", "i", "j", "v_view", "v_click")
    other = cube.withColumn("v_view", F.col("v_view") + F.when(F.col("t") % 7 == 2, 1).otherwise(0))
    return merge.merge_conflicts([cube, other])


@query("monthly_midmonth", """
    SELECT y.time, c.cell::INT AS cell, m.value FROM all_days y CROSS JOIN range(8) c(cell)
    LEFT JOIN monthly m ON m.month = date_trunc('month', y.time)::DATE AND m.cell = c.cell""")
def monthly_midmonth(spark, d):
    """Frames dated on the 15th, and in each month a later one that does not count."""
    mid = v.monthly(spark, d).withColumn("month", F.date_add("month", 14))
    later = mid.withColumns({"month": F.date_add("month", 5), "value": F.col("value") + 1})
    return fill.monthly_to_daily(mid.unionByName(later), v.CAL_START, v.CAL_END, _cells8(spark))


@query("concat_time", "SELECT time, t, i, j, v_view, " + ", ".join(f"CASE WHEN t >= 15 THEN {c} END AS {c}" for c in VALUES[1:]) + " FROM cube_wide")
def concat_time(spark, d):
    whole = v.cube_wide(spark, d)
    return merge.concat_time([whole.filter("t < 15").select("time", "t", "i", "j", "v_view"), whole.filter("t >= 15").select("time", "t", "i", "j", *VALUES)])


@query("check_alignment", """
    WITH a AS (SELECT 'lat' AS axis, i AS pos, max(lat) AS c FROM cube GROUP BY i UNION ALL SELECT 'lon', j, max(lon) FROM cube GROUP BY j
               UNION ALL SELECT DISTINCT 'time', t, 0.0 FROM cube),
         b AS (SELECT 'click' AS dataset, axis, pos, c FROM (SELECT 'lat' AS axis, i AS pos, max(lat) AS c FROM cube WHERE i <> 3 GROUP BY i
               UNION ALL SELECT 'lon', j, max(lon) FROM cube WHERE i <> 3 GROUP BY j UNION ALL SELECT DISTINCT 'time', t, 0.0 FROM cube WHERE i <> 3)
               UNION ALL SELECT 'error', axis, pos, c FROM (SELECT 'lat' AS axis, i AS pos, max(lat) AS c FROM cube WHERE t < 20 GROUP BY i
               UNION ALL SELECT 'lon', j, max(lon) + 0.05 FROM cube WHERE t < 20 GROUP BY j UNION ALL SELECT DISTINCT 'time', t, 0.0 FROM cube WHERE t < 20)),
         pairs AS (SELECT n.dataset, coalesce(a.axis, b.axis) AS axis, a.c AS x, b.c AS y FROM (VALUES ('click'), ('error')) n(dataset)
               JOIN a ON true LEFT JOIN b ON b.dataset = n.dataset AND b.axis = a.axis AND b.pos = a.pos)
    SELECT dataset, axis, count(*) FILTER (WHERE y IS NULL OR abs(x - y) > 1e-8 + 1e-5 * abs(y)) AS n_mismatch FROM pairs GROUP BY dataset, axis""")
def check_alignment(spark, d):
    c = cube(spark, d)
    return merge.check_alignment({"view": c, "click": c.filter("i <> 3"), "error": c.filter("t < 20").withColumn("lon", F.col("lon") + 0.05)})


@query("analysis_cube", """
    WITH day AS (SELECT t, i, j, v_view / 100 AS chla, v_click AS par, v_error / 10 AS sst, v_signup / 10 AS wind FROM cube_wide),
         block AS (SELECT t, (i // 2)::INT AS i, (j // 2)::INT AS j, avg(chla) AS chla, avg(par) AS par, avg(sst) AS sst, avg(wind) AS wind FROM day GROUP BY t, i // 2, j // 2),
         s1 AS (SELECT *, CASE WHEN chla <= 0.5 THEN 38 * pow(chla, 0.425) ELSE 40.2 * pow(chla, 0.507) END AS ct FROM block),
         s2 AS (SELECT *, CASE WHEN ct <= 13.62 THEN 4.6::DOUBLE / 426.3 * pow(ct, 0.547) ELSE 4.6::DOUBLE / 912.5 * pow(ct, 0.839) END AS kd, 2675.0::DOUBLE - 147.12 * sst + 3.726 * sst * sst - 0.038 * sst * sst * sst AS sc FROM s1),
         s3 AS (SELECT *, CASE WHEN par <= 11.425 THEN 0 WHEN kd = 0 THEN 0 ELSE ln(par / 11.425) / kd END AS hm FROM s2),
         s4 AS (SELECT *, least(hm, 1) AS h, CASE WHEN hm > 0 THEN ct / hm ELSE 0 END AS ca FROM s3 WHERE chla IS NOT NULL AND par IS NOT NULL AND sst IS NOT NULL AND wind IS NOT NULL AND sc >= 0)
    SELECT b.t, b.i, b.j, round(b.chla, 6) + 0.0 AS chla, round(b.par, 6) + 0.0 AS par, round(b.sst, 6) + 0.0 AS sst, round(b.wind, 6) + 0.0 AS wind,
      round(86.8798::DOUBLE * ca * 24 * CASE WHEN h = 0 OR kd = 0 THEN 0 ELSE 0.042::DOUBLE * 3.6402 / (pow(s4.sst + 1, 2) - 46.75 * (s4.sst + 1) + 618.2) * (pow(ln(s4.par), 3) - pow(ln(s4.par) - kd * h, 3)) / (3 * kd) END
        / (0.14::DOUBLE * pow(ca, 1.28) + 0.055 + (0.222::DOUBLE * s4.wind * s4.wind + 0.333 * s4.wind) * pow(sc / 600, -0.5) * 0.24), 5) + 0.0 AS isoprene
    FROM block b LEFT JOIN s4 USING (t, i, j)""")
def analysis_cube(spark, d):
    """Raw variables on the fine grid to one coarse table with the derived quantity."""
    from gridspark.functions.isoprene import with_isoprene

    day = v.cube_wide(spark, d).select("t", "i", "j", (F.col("v_view") / 100).alias("chla"), F.col("v_click").alias("par"),
                                       (F.col("v_error") / 10).alias("sst"), (F.col("v_signup") / 10).alias("wind"))
    names = ["chla", "par", "sst", "wind"]
    out = with_isoprene(regrid.coarsen(day, 2, names, "pad"))
    return rounded(out, names).withColumn("isoprene", F.round("isoprene", 5) + F.lit(0.0))


# chlorophyll as block means then linear, light and wind linear, temperature nearest, all on half positions
@query("merged_products", f"""
    WITH blocks AS (SELECT t, i // 2 AS i, j // 2 AS j, avg(v_view) / 100 AS chla FROM cube_wide WHERE i < 12 AND j < 24 GROUP BY t, i // 2, j // 2),
         -- block centres lie at 0.5, 2.5, ..: the half position k/2 is (k - 1) / 4 blocks along
         bpos AS (SELECT k AS tgt, (k - 1) // 4 AS lo, ((k - 1) % 4)::DOUBLE / 4 AS f FROM range(1, 46) r(k)),
         bw AS (SELECT tgt, lo AS src, 1 - f AS w, CASE WHEN f = 0 THEN 1 ELSE 2 END AS need FROM bpos UNION ALL SELECT tgt, lo + 1, f, 2 FROM bpos WHERE f > 0),
         pos AS (SELECT k AS tgt, k // 2 AS lo, (k % 2)::DOUBLE / 2 AS f FROM range(47) r(k)),
         pw AS (SELECT tgt, lo AS src, 1 - f AS w, CASE WHEN f = 0 THEN 1 ELSE 2 END AS need FROM pos UNION ALL SELECT tgt, lo + 1, f, 2 FROM pos WHERE f > 0),
         a AS (SELECT t, x.tgt AS i, y.tgt AS j, CASE WHEN count(chla) = max(x.need * y.need) THEN sum(x.w * y.w * chla) END AS chla FROM blocks b JOIN bw x ON b.i = x.src AND x.tgt < 22 JOIN bw y ON b.j = y.src GROUP BY ALL),
         l AS (SELECT t, x.tgt AS i, y.tgt AS j, CASE WHEN count(v_click) = max(x.need * y.need) THEN sum(x.w * y.w * v_click) END AS par,
                      CASE WHEN count(v_signup) = max(x.need * y.need) THEN sum(x.w * y.w * v_signup) / 10 END AS wind FROM cube_wide c JOIN pw x ON c.i = x.src AND x.tgt < 23 JOIN pw y ON c.j = y.src GROUP BY ALL),
         n AS (SELECT t, x.k AS i, y.k AS j, v_error / 10 AS sst FROM cube_wide c JOIN (SELECT k FROM range(23) r(k)) x ON c.i = x.k // 2 JOIN (SELECT k FROM range(47) r(k)) y ON c.j = y.k // 2)
    SELECT t, i::INT AS i, j::INT AS j, i / 2.0::DOUBLE AS lat, j / 2.0::DOUBLE AS lon, round(chla, 6) AS chla, round(par, 6) AS par, round(sst, 6) AS sst, round(wind, 6) AS wind
    FROM a FULL JOIN l USING (t, i, j) FULL JOIN n USING (t, i, j)""")
def merged_products(spark, d):
    day = v.cube_wide(spark, d).select("t", "i", "j", (F.col("v_view") / 100).alias("chla"), F.col("v_click").alias("par"),
                                       (F.col("v_error") / 10).alias("sst"), (F.col("v_signup") / 10).alias("wind"))
    own = (index_axis(spark, v.N_LAT), index_axis(spark, v.N_LON))
    half = (index_axis(spark, 23, 1, 2), index_axis(spark, 47, 1, 2))
    cube = analysis.analysis_cube([analysis.Product(day, ("chla",), own, factor=2), analysis.Product(day, ("par", "wind"), own),
                                   analysis.Product(day, ("sst",), own, method="nearest")], half)
    return rounded(cube, ["chla", "par", "sst", "wind"])


@query("quarter_degree_cube", """
    WITH blocks AS (SELECT t, i // 5 AS bi, j // 5 AS bj, avg(v_view) AS v_view, avg(v_click) AS v_click FROM cube_wide GROUP BY ALL),
         -- five cells a block, the last one shorter; block centres are means of their cells
         lat AS (SELECT b, avg(k) AS c FROM (SELECT k, k // 5 AS b FROM range(12) r(k)) GROUP BY b), lon AS (SELECT b, avg(k) AS c FROM (SELECT k, k // 5 AS b FROM range(24) r(k)) GROUP BY b),
         tgt AS (SELECT k, 1 + 2.0::DOUBLE * k + 1 AS x FROM range(12) r(k)),
         ti AS (SELECT k, arg_min(b, (abs(c - x), -b)) AS b FROM tgt, lat WHERE x <= 10.5 GROUP BY k), tj AS (SELECT k, arg_min(b, (abs(c - x), -b)) AS b FROM tgt, lon WHERE x <= 22 GROUP BY k)
    SELECT t, ti.k::INT AS i, tj.k::INT AS j, 2 + 2.0::DOUBLE * ti.k AS lat, 2 + 2.0::DOUBLE * tj.k AS lon, round(v_view, 6) AS v_view, round(v_click, 6) AS v_click
    FROM blocks JOIN ti ON bi = ti.b JOIN tj ON bj = tj.b""")
def quarter_degree_cube(spark, d):
    """Padded block means on a cell-centred target axis, by the nearest block."""
    day = v.cube_wide(spark, d).select("t", "i", "j", "v_view", "v_click")
    own = (index_axis(spark, v.N_LAT), index_axis(spark, v.N_LON))
    target = (axes.regular_axis(spark, 1, 11, 2, centred=True), axes.regular_axis(spark, 1, 23, 2, centred=True))
    cube = analysis.analysis_cube([analysis.Product(day, ("v_view", "v_click"), own, "nearest", 5, "pad")], target)
    return rounded(cube, ["v_view", "v_click"])


@query("calendar_axis", """
    SELECT time, count(o.o_orderkey) AS n_orders FROM all_days LEFT JOIN orders o ON o.o_orderdate::DATE = time GROUP BY time""")
def calendar_axis(spark, d):
    days = axes.calendar(spark, v.CAL_START, v.CAL_END)
    counts = v.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("time")).agg(F.count("o_orderkey").alias("n"))
    return days.join(counts, "time", "left").select("time", F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"))


@query("month_bounds", """
    SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS first_day, last_day(o_orderdate::DATE) AS last_day FROM orders""")
def month_bounds(spark, d):
    day = F.to_date("o_orderdate")
    return v.table(spark, d, "orders").select("o_orderkey", dates.month_start(day).alias("first_day"), dates.month_end(day).alias("last_day"))


@query("days_encode", "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT AS days, o_orderdate::DATE AS back FROM orders")
def days_encode(spark, d):
    coded = v.table(spark, d, "orders").select("o_orderkey", dates.days_since_epoch(F.to_date("o_orderdate")).alias("days"))
    return coded.withColumn("back", dates.date_of_days(F.col("days") + F.lit(0.5)))


@query("fill_days", """
    WITH day_of AS (SELECT y.time, coalesce(max(f.time), (SELECT min(time) FROM frames)) AS source_day FROM all_days y
                    LEFT JOIN (SELECT DISTINCT time FROM frames) f ON f.time <= y.time GROUP BY y.time)
    SELECT d.time, f.cell, f.value, d.source_day, d.time = d.source_day AS is_original FROM day_of d JOIN frames f ON f.time = d.source_day""")
def fill_days(spark, d):
    return fill.fill_days(v.frames(spark, d), v.CAL_START, v.CAL_END)


@query("fill_days_strict", """
    WITH day_of AS (SELECT y.time, max(f.time) AS source_day FROM all_days y
                    JOIN (SELECT DISTINCT time FROM frames) f ON f.time <= y.time WHERE y.time >= DATE '1995-01-03' GROUP BY y.time)
    SELECT d.time, f.cell, f.value, d.source_day, d.time = d.source_day AS is_original FROM day_of d JOIN frames f ON f.time = d.source_day""")
def fill_days_strict(spark, d):
    from datetime import date

    return fill.fill_days(v.frames(spark, d), date(1995, 1, 3), v.CAL_END, leading="error")


@query("provenance", """
    WITH day_of AS (SELECT y.time, coalesce(max(f.time), (SELECT min(time) FROM frames)) AS source_day FROM all_days y
                    LEFT JOIN (SELECT DISTINCT time FROM frames) f ON f.time <= y.time GROUP BY y.time)
    SELECT time = source_day AS is_original, count(*) AS n_days, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM all_days), 6) AS percent FROM day_of GROUP BY 1""")
def provenance(spark, d):
    return rounded(fill.provenance_summary(fill.day_map(v.frames(spark, d), v.CAL_START, v.CAL_END)), ["percent"])


def _cells8(spark):
    return spark.range(8).select(F.col("id").cast("int").alias("cell"))


@query("monthly_to_daily", """
    SELECT y.time, c.cell::INT AS cell, m.value FROM all_days y CROSS JOIN range(8) c(cell)
    LEFT JOIN monthly m ON m.month = date_trunc('month', y.time)::DATE AND m.cell = c.cell""")
def monthly_to_daily(spark, d):
    return fill.monthly_to_daily(v.monthly(spark, d), v.CAL_START, v.CAL_END, _cells8(spark))


@query("null_frames", """
    SELECT c.cell::INT AS cell, y.time, NULL::DOUBLE AS value FROM all_days y CROSS JOIN range(8) c(cell)
    WHERE y.time NOT IN (SELECT time FROM frames)""")
def null_frames(spark, d):
    absent = fill.day_map(v.frames(spark, d), v.CAL_START, v.CAL_END).filter(~F.col("is_original"))
    return fill.null_frames(_cells8(spark), absent, ["value"])
