"""Changing the grid: block means, interpolation, neighbourhoods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from gridspark.operators.axes import Axis, with_coordinates
from gridspark.operators.small import join_small


def _block(c: str, factor: int) -> Column:
    return F.floor(F.col(c) / F.lit(factor)).cast("int")


def _whole_blocks(n: int | None, df: DataFrame, c: str, factor: int) -> Column:
    length = F.lit(n) if n is not None else df.agg(F.max(c) + 1).scalar()
    return F.floor(length / F.lit(factor)) * F.lit(factor)


def coarsen(df: DataFrame, factor: int, values: Sequence[str], boundary: str = "trim", n_lat: int | None = None,
            n_lon: int | None = None, frame: Sequence[str] = ("t",)) -> DataFrame:
    """Block means of `factor` x `factor` cells, missing values skipped.

    `trim` drops the incomplete blocks at the end of each axis (D1), `pad` keeps them (D2).
    The axis lengths are measured when not given. One shuffle, of partial sums.
    """
    if boundary not in ("trim", "pad"):
        raise ValueError(f"unknown boundary rule: {boundary}")
    if boundary == "trim":
        df = df.filter((F.col("i") < _whole_blocks(n_lat, df, "i", factor)) & (F.col("j") < _whole_blocks(n_lon, df, "j", factor)))
    return df.groupBy(*frame, _block("i", factor).alias("i"), _block("j", factor).alias("j")).agg(
        *(F.avg(v).alias(v) for v in values)
    )


def coarsen_axis(axis: Axis, factor: int, boundary: str = "trim") -> Axis:
    """Coordinates of the blocks: the mean of the cells each holds."""
    whole = axis.size // factor
    size = whole if boundary == "trim" else -(-axis.size // factor)
    table = (
        axis.table.filter(F.col("idx") < size * factor)
        .groupBy(_block("idx", factor).alias("idx"))
        .agg(F.avg("coord").alias("coord"))
    )
    return Axis(table, size)


def _neighbours(source: Axis, target: Axis) -> DataFrame:
    """For each target position the source positions at or below and at or above it."""
    node = F.struct(F.col("coord").alias("at"), F.col("idx").alias("src"))
    both = source.table.select("coord", F.lit(None).cast("int").alias("tgt"), node.alias("node")).unionByName(
        target.table.select("coord", F.col("idx").alias("tgt")), allowMissingColumns=True
    )
    upward = W.orderBy(F.col("coord").asc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    downward = W.orderBy(F.col("coord").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    return (
        both.select("tgt", "coord", F.max("node").over(upward).alias("lo"), F.min("node").over(downward).alias("hi"))
        .filter(F.col("tgt").isNotNull() & F.col("lo").isNotNull() & F.col("hi").isNotNull())
    )


def linear_weights(source: Axis, target: Axis) -> DataFrame:
    """Contributions `(src, tgt, w, need)` of one axis; targets outside the source have none.

    `need` is how many source positions a target rests on: two, or one on an exact hit.
    """
    share = (F.col("coord") - F.col("lo.at")) / (F.col("hi.at") - F.col("lo.at"))
    exact = F.col("lo.src") == F.col("hi.src")
    one = F.array(F.struct(F.col("lo.src").alias("src"), F.lit(1.0).alias("w"), F.lit(1).alias("need")))
    two = F.array(
        F.struct(F.col("lo.src").alias("src"), (F.lit(1.0) - share).alias("w"), F.lit(2).alias("need")),
        F.struct(F.col("hi.src").alias("src"), share.alias("w"), F.lit(2).alias("need")),
    )
    return (
        _neighbours(source, target)
        .select("tgt", F.explode(F.when(exact, one).otherwise(two)).alias("c"))
        .select("c.src", "tgt", "c.w", "c.need")
    )


def nearest_map(source: Axis, target: Axis) -> DataFrame:
    """`(src, tgt)` of one axis; a midpoint goes to the lower coordinate, outside has no source."""
    lower = (F.col("coord") - F.col("lo.at")) <= (F.col("hi.at") - F.col("coord"))
    return _neighbours(source, target).select(
        F.when(lower, F.col("lo.src")).otherwise(F.col("hi.src")).alias("src"), "tgt"
    )


def regrid_linear(df: DataFrame, values: Sequence[str], source: tuple[Axis, Axis], target: tuple[Axis, Axis],
                  frame: Sequence[str] = ("t",), coordinates: bool = True) -> DataFrame:
    """Bilinear interpolation onto the target axes (C6), all variables in one pass.

    Weights come from the axes alone and are broadcast. A target is missing when any cell
    it rests on is missing, as a NULL or as an absent row; targets outside the source grid
    give no row.
    """
    lat_w = linear_weights(source[0], target[0]).select(F.col("src").alias("i"), F.col("tgt").alias("ti"), F.col("w").alias("wi"), F.col("need").alias("ni"))
    lon_w = linear_weights(source[1], target[1]).select(F.col("src").alias("j"), F.col("tgt").alias("tj"), F.col("w").alias("wj"), F.col("need").alias("nj"))
    parts = join_small(join_small(df.select(*frame, "i", "j", *values), lat_w, "i", rows=2 * target[0].size),
                       lon_w, "j", rows=2 * target[1].size)
    weight = F.col("wi") * F.col("wj")
    sums = [F.sum(weight * F.col(v)).alias(v) for v in values]
    counts = [F.count(v).alias(f"_n_{v}") for v in values]
    out = (
        parts.groupBy(*frame, "ti", "tj")
        .agg(*sums, *counts, F.max(F.col("ni") * F.col("nj")).alias("_need"))
        .select(*frame, F.col("ti").alias("i"), F.col("tj").alias("j"),
                *(F.when(F.col(f"_n_{v}") == F.col("_need"), F.col(v)).alias(v) for v in values))
    )
    return with_coordinates(out, *target) if coordinates else out


def regrid_nearest(df: DataFrame, values: Sequence[str], source: tuple[Axis, Axis], target: tuple[Axis, Axis],
                   frame: Sequence[str] = ("t",), coordinates: bool = True) -> DataFrame:
    """Nearest-neighbour regrid (C7): two broadcast joins, no shuffle."""
    lat_m = nearest_map(source[0], target[0]).select(F.col("src").alias("i"), F.col("tgt").alias("ti"))
    lon_m = nearest_map(source[1], target[1]).select(F.col("src").alias("j"), F.col("tgt").alias("tj"))
    picked = join_small(join_small(df.select(*frame, "i", "j", *values), lat_m, "i", rows=target[0].size),
                        lon_m, "j", rows=target[1].size)
    out = picked.select(*frame, F.col("ti").alias("i"), F.col("tj").alias("j"), *values)
    return with_coordinates(out, *target) if coordinates else out


def _resize_weights(extents: DataFrame, size: int) -> DataFrame:
    """Contributions `(n, src, tgt, w, need)` for each extent `n`: the first and last of n positions lie on those of the target axis.

    Places are fractions of whole numbers, so an exact hit is exact.
    """
    steps = max(size - 1, 1)
    tgt = extents.select("n", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("tgt"))
    place = F.col("tgt").cast("long") * (F.col("n") - 1)
    low, over = F.expr(f"place div {steps}"), F.col("place") % steps
    share = over / F.lit(float(steps))
    one = F.array(F.struct(F.col("low").alias("src"), F.lit(1.0).alias("w"), F.lit(1).alias("need")))
    two = F.array(F.struct(F.col("low").alias("src"), (F.lit(1.0) - share).alias("w"), F.lit(2).alias("need")),
                  F.struct((F.col("low") + 1).alias("src"), share.alias("w"), F.lit(2).alias("need")))
    parts = tgt.withColumn("place", place).withColumn("low", low).withColumn("c", F.explode(F.when(over == 0, one).otherwise(two)))
    return parts.select("n", F.col("c.src").cast("int").alias("src"), "tgt", "c.w", "c.need")


def resize_frames(df: DataFrame, values: Sequence[str], n_lat: int, n_lon: int, dims: Sequence[str], shape: Sequence[str],
                  frame: Sequence[str] = ("time",)) -> DataFrame:
    """Frames of any stored extents `shape`, at positions `dims`, bilinearly onto an `n_lat` x `n_lon` grid: `(frame, i, j, values)`.

    The corners of a frame lie on the corners of the grid. Weights are made for the distinct extents found, so
    frames of mixed resolutions go through one plan; they meet the cells on extent and position. A target is
    missing when any cell it rests on is missing, as a NULL or as an absent row.
    """
    (d0, d1), (n0, n1) = dims, shape
    weights = []
    for n, size, names in ((n0, n_lat, (d0, "i", "wi", "ni")), (n1, n_lon, (d1, "j", "wj", "nj"))):
        table = _resize_weights(df.select(F.col(n).cast("int").alias("n")).filter("n > 0").distinct(), size)
        weights.append(table.select(F.col("n").alias(n), F.col("src").alias(names[0]), F.col("tgt").alias(names[1]), F.col("w").alias(names[2]), F.col("need").alias(names[3])))
    parts = join_small(join_small(df.select(*frame, d0, d1, n0, n1, *values), weights[0], [n0, d0]), weights[1], [n1, d1])
    share = F.col("wi") * F.col("wj")
    out = parts.groupBy(*frame, "i", "j").agg(*(F.sum(share * F.col(v)).alias(v) for v in values), *(F.count(v).alias(f"_n_{v}") for v in values),
                                              F.max(F.col("ni") * F.col("nj")).alias("_need"))
    return out.select(*frame, "i", "j", *(F.when(F.col(f"_n_{v}") == F.col("_need"), F.col(v)).alias(v) for v in values))


def neighbour_features(df: DataFrame, values: Sequence[str], n_lat: int, n_lon: int, frame: Sequence[str] = ("t",)) -> DataFrame:
    """The values beside their 3x3 means `<value>_near`, as extra inputs of the lag model.

    The mean is over nine cells with zero outside the grid and for missing values. One
    shuffle carries both.
    """
    offsets = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    own = (F.col("o.di") == 0) & (F.col("o.dj") == 0)
    shares = df.select(*frame, "i", "j", *values, F.explode(offsets).alias("o")).select(
        *frame, (F.col("i") - F.col("o.di")).alias("i"), (F.col("j") - F.col("o.dj")).alias("j"),
        *(F.coalesce(F.col(v), F.lit(0.0)).alias(f"{v}_near") for v in values), *(F.when(own, F.col(v)).alias(v) for v in values))
    inside = (F.col("i") >= 0) & (F.col("i") < n_lat) & (F.col("j") >= 0) & (F.col("j") < n_lon)
    return shares.filter(inside).groupBy(*frame, "i", "j").agg(
        *(F.max(v).alias(v) for v in values), *((F.sum(f"{v}_near") / F.lit(9.0)).alias(f"{v}_near") for v in values))


def stencil_tiles(df: DataFrame, values: Sequence[str], weights: Mapping[tuple[int, int], float], n_lat: int, n_lon: int,
                  frame: Sequence[str] = ("t",), tile: int = 32) -> DataFrame:
    """The same sums as `stencil`, from tiles with halos (C12): a cell is shuffled once, and once more for each tile whose border it is near.

    Cells are packed into tiles of `tile` x `tile`; a cell within the kernel's reach of other tiles is copied into
    their halos. A kernel of any size then costs one shuffle of about (1 + 2 * reach / tile)^2 rows per cell, where
    `stencil` sends a row per weight. A tile is one group, so groups are of bounded size.
    """
    reach = max((max(abs(a), abs(b)) for a, b in weights), default=0)
    if reach > tile:
        raise ValueError(f"a kernel that reaches {reach} cells needs tiles of that size")
    side = tile + 2 * reach
    rows, columns = -(-n_lat // tile), -(-n_lon // tile)
    near = lambda c, n: F.filter(F.array(*(F.floor((F.col(c) + d) / F.lit(tile)).cast("int") for d in ((-reach, reach) if reach else (0,)))), lambda k: (k >= 0) & (k < n))
    inside = (F.col("i") >= 0) & (F.col("i") < n_lat) & (F.col("j") >= 0) & (F.col("j") < n_lon)
    # reach <= tile, so the tiles at either reach and the cell's own are all that it can meet
    tiles = lambda c, n: F.array_distinct(F.concat(near(c, n), F.array(F.floor(F.col(c) / F.lit(tile)).cast("int"))))
    packed = (df.filter(inside).select(*frame, "i", "j", *(F.col(v).cast("double").alias(v) for v in values))
              .withColumn("ti", F.explode(tiles("i", rows))).withColumn("tj", F.explode(tiles("j", columns))))
    kernel = [((a, b), float(w)) for (a, b), w in sorted(weights.items())]
    keys = list(frame)
    schema = T.StructType([*(df.schema[c] for c in keys), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), *(T.StructField(v, T.DoubleType()) for v in values)])

    def convolve(key: tuple, cells: pa.Table) -> pa.Table:
        top, left = key[-2].as_py() * tile, key[-1].as_py() * tile
        at = (cells["i"].to_numpy() - top + reach, cells["j"].to_numpy() - left + reach)
        window = lambda dense, a, b: dense[reach + a:reach + a + tile, reach + b:reach + b + tile]
        held = np.zeros((side, side), bool)
        held[at] = True
        meets = np.zeros((tile, tile), bool)
        for (a, b), _ in kernel:
            meets |= window(held, a, b)
        meets[max(0, n_lat - top):], meets[:, max(0, n_lon - left):] = False, False
        i, j = np.nonzero(meets)
        out = {c: pa.array([key[k].as_py()] * len(i), cells.schema.field(c).type) for k, c in enumerate(keys)}
        out |= {"i": pa.array((i + top).astype(np.int32)), "j": pa.array((j + left).astype(np.int32))}
        for v in values:
            dense, total = np.zeros((side, side)), np.zeros((tile, tile))
            dense[at] = np.nan_to_num(cells[v].to_numpy(), nan=0.0, posinf=np.inf, neginf=-np.inf)
            for (a, b), w in kernel:
                total += w * window(dense, a, b)
            out[v] = pa.array(total[i, j])
        return pa.table(out)

    return packed.groupBy(*keys, "ti", "tj").applyInArrow(convolve, schema)


def stencil(df: DataFrame, values: Sequence[str], weights: Mapping[tuple[int, int], float], n_lat: int, n_lon: int,
            frame: Sequence[str] = ("t",)) -> DataFrame:
    """Weighted sum over neighbouring cells, zero outside the grid and for missing values.

    `weights[(di, dj)]` belongs to the cell `di` rows and `dj` columns away. Each cell sends
    its share to its neighbours; shares are summed on the map side before the one shuffle.
    """
    offsets = F.array(*(
        F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj"), F.lit(float(w)).alias("w"))
        for (di, dj), w in sorted(weights.items())
    ))
    shares = df.select(*frame, "i", "j", *values, F.explode(offsets).alias("o")).select(
        *frame, (F.col("i") - F.col("o.di")).alias("i"), (F.col("j") - F.col("o.dj")).alias("j"),
        *((F.coalesce(F.col(v), F.lit(0.0)) * F.col("o.w")).alias(v) for v in values),
    )
    inside = (F.col("i") >= 0) & (F.col("i") < n_lat) & (F.col("j") >= 0) & (F.col("j") < n_lon)
    return shares.filter(inside).groupBy(*frame, "i", "j").agg(*(F.sum(v).alias(v) for v in values))
