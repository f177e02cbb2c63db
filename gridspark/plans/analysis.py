"""From products on their own grids to one analysis cube."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gridspark.functions.isoprene import with_isoprene
from gridspark.operators.axes import Axis, with_coordinates
from gridspark.operators.merge import merge_cubes
from gridspark.operators.regrid import coarsen, coarsen_axis, regrid_linear, regrid_nearest


@dataclass(frozen=True)
class Product:
    """Variables on one source grid and how they reach the target grid.

    `factor` above 1 takes block means first, as for sources much finer than the target;
    `boundary` says whether incomplete blocks at the end of an axis are kept (`pad`) or dropped (`trim`).
    """

    cube: DataFrame
    variables: tuple[str, ...]
    source: tuple[Axis, Axis]
    method: str = "linear"
    factor: int = 1
    boundary: str = "trim"


def on_target(product: Product, target: tuple[Axis, Axis]) -> DataFrame:
    """The product's variables on the target grid, `(t, i, j, <variables>)`."""
    cube, source, names = product.cube, product.source, list(product.variables)
    if product.factor > 1:
        cube = coarsen(cube, product.factor, names, product.boundary, source[0].size, source[1].size)
        source = tuple(coarsen_axis(a, product.factor, product.boundary) for a in source)
    regrid = {"linear": regrid_linear, "nearest": regrid_nearest}[product.method]
    return regrid(cube, names, source, target, coordinates=False)


def analysis_cube(products: Sequence[Product], target: tuple[Axis, Axis]) -> DataFrame:
    """All variables side by side on the target grid, with coordinates."""
    return with_coordinates(merge_cubes([on_target(p, target) for p in products]), *target)


def isoprene_cube(products: Sequence[Product], target: tuple[Axis, Axis]) -> DataFrame:
    """The analysis cube with isoprene; it needs `chla`, `par`, `sst` and `wind` among the variables."""
    return with_isoprene(analysis_cube(products, target))
