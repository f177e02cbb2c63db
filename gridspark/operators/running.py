"""Running totals and ranks that do not send one whole group to one task.

Rows are cut into blocks along their order. Block totals are tiny and are accumulated
first; inside a block the running value starts from the total of the blocks before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridspark.operators.small import join_small

#: Rows of known number that one task may order.
ONE_TASK_ROWS = 100_000
_TOTAL = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(op: str, before: Column, here: Column) -> Column:
    if op == "min":
        return F.least(before, here)
    if op == "max":
        return F.greatest(before, here)
    return F.coalesce(before + here, before, here)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
            totals: Mapping[str, tuple[str, Column]], inclusive: bool = True, blocks: int | None = None) -> DataFrame:
    """Add running `sum`, `min` or `max` columns per key, in the given order.

    `block` must not decrease along the order; a NULL block comes first, and a NULL key is a key
    like any other. `inclusive=False` leaves out the row itself. `blocks` bounds the blocks of all
    keys, where known: then their totals are broadcast. Otherwise Spark picks the join of rows and
    block totals from the sizes it finds at run time.
    With one block there is nothing to carry over, and a key's rows are known to fit a task.
    """
    end = W.currentRow if inclusive else -1
    if blocks == 1:
        whole = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, end)
        return df.withColumns({name: _TOTAL[op](c).over(whole) for name, (op, c) in totals.items()})
    cut = df.withColumn("_block", block)
    per_block = cut.groupBy(*keys, "_block").agg(*(_TOTAL[op](c).alias(name) for name, (op, c) in totals.items()))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = per_block.select(*keys, "_block", *(_TOTAL[op](name).over(earlier).alias(f"_before_{name}") for name, (op, _) in totals.items()))
    names = [*keys, "_block"]
    before = before.withColumnsRenamed({c: f"_at_{c}" for c in names})
    on = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in names))
    joined = join_small(cut, before, on, rows=blocks)
    here = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    return joined.withColumns({
        name: _combine(op, F.col(f"_before_{name}"), _TOTAL[op](c).over(here)) for name, (op, c) in totals.items()
    }).drop("_block", *(f"_at_{c}" for c in names), *(f"_before_{name}" for name in totals))


def global_rank(df: DataFrame, order: str, lo: int, hi: int, ties: Sequence[str] = (), out: str = "rank",
                n_blocks: int = 1024, rows: int | None = None) -> DataFrame:
    """0-based position of every row in the order of an integer column known to lie in [lo, hi].

    `rows` bounds the rows where that is known; so few that one task orders them are not cut into blocks.
    """
    if rows is not None and rows <= ONE_TASK_ROWS:
        n_blocks = 1
    width = max(1, -(-(hi - lo + 1) // n_blocks))
    block = F.floor((F.col(order) - F.lit(lo)) / F.lit(width)).cast("int")
    ranked = running(df, [], [order, *ties], block, {out: ("sum", F.lit(1).cast("long"))}, blocks=n_blocks)
    return ranked.withColumn(out, (F.col(out) - 1).cast("int"))


def with_quantile_block(df: DataFrame, order: str, n_blocks: int = 1024, out: str = "_block") -> DataFrame:
    """Add the block of each row in the order of a numeric column, from its quantiles: blocks hold about equally many rows.

    The quantiles are merged sketches of fixed size. A value finds its block by binary search, which
    reads one cut per halving.
    """
    steps = [1 << k for k in reversed(range(max(1, (n_blocks - 1).bit_length())))]
    shares = [k / n_blocks for k in range(1, n_blocks)]
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), shares, 10 * n_blocks)).scalar()
    value = F.col(order).cast("double")
    halve = lambda at, step: at + F.when(F.get(F.col("_cuts"), at + step - 1) <= value, step).otherwise(F.lit(0))
    return df.withColumn("_cuts", cuts).withColumn(out, F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)).drop("_cuts")


def rank_distinct(df: DataFrame, column: str, out: str, tolerance: float | None = None, n_blocks: int = 64) -> DataFrame:
    """The distinct values of a numeric column with their 0-based places in ascending order: `(column, out)`, NULL left out.

    With a tolerance, a value at most that far above the one before it shares its place. Values are cut into
    blocks by quantiles and ranked inside them; no more than the block totals meet in one task.
    """
    values = with_quantile_block(df.select(column).filter(F.col(column).isNotNull()).distinct(), column, n_blocks, "_part")
    opens = F.lit(1).cast("long")
    if tolerance is not None:
        values = running(values, [], [column], F.col("_part"), {"_before": ("max", F.col(column))}, inclusive=False, blocks=n_blocks)
        opens = F.when(F.col(column) - F.col("_before") <= F.lit(float(tolerance)), 0).otherwise(1).cast("long")
    ranked = running(values, [], [column], F.col("_part"), {out: ("sum", opens)}, blocks=n_blocks)
    return ranked.select(column, (F.col(out) - 1).cast("int").alias(out))
