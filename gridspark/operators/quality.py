"""Reports on cubes and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.operators.small import join_small


def value_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per variable: min, max, mean, population deviation, valid and total counts (D5). One pass."""
    one = df.agg(F.count(F.lit(1)).alias("n_total"), *(
        F.struct(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"),
                 F.stddev_pop(c).alias("std"), F.count(c).alias("n_valid")).alias(c) for c in columns))
    return one.select("n_total", F.explode(F.array(*(
        F.struct(F.lit(c).alias("var"), F.col(c).alias("s")) for c in columns))).alias("e")).select(
        "e.var", "e.s.*", "n_total").withColumn("percent_valid", _percent(F.col("n_valid"), F.col("n_total")))


def _percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def coverage(df: DataFrame, column: str, total_cells: int | None = None) -> DataFrame:
    """Valid cells in percent of all (D6). Give the grid's size where absent rows stand for missing."""
    total = F.count(F.lit(1)) if total_cells is None else F.lit(total_cells).cast("long")
    return df.agg(F.count(column).alias("n_valid"), total.alias("n_total")).withColumn(
        "coverage", _percent(F.col("n_valid"), F.col("n_total")))


def daily_missing(df: DataFrame, column: str, limit: float, cells: int | None = None, by: Sequence[str] = ("time",)) -> DataFrame:
    """Missing share per day in percent and whether it exceeds the limit."""
    total = F.count(F.lit(1)) if cells is None else F.lit(cells).cast("long")
    return df.groupBy(*by).agg(F.count(column).alias("n_valid"), total.alias("n_total")).withColumn(
        "missing", F.lit(100.0) - _percent(F.col("n_valid"), F.col("n_total"))).withColumn("flagged", F.col("missing") > limit)


def zonal_mean(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("lat",)) -> DataFrame:
    """Mean over longitude (D9), missing values skipped."""
    return df.groupBy(*by).agg(*(F.avg(c).alias(c) for c in columns))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed (D10): every bin has a row.

    Values are placed by division, then moved by one bin if they lie beyond its printed edge.
    """
    v = F.col(column)
    ends = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("ends")).scalar()
    e = F.col("ends")
    flat = e["lo"] == e["hi"]
    lo = F.when(flat, e["lo"] - 0.5).otherwise(e["lo"])
    hi = F.when(flat, e["hi"] + 0.5).otherwise(e["hi"])

    def with_bins(rows: DataFrame) -> DataFrame:
        return rows.withColumn("ends", ends).withColumns({"lo": lo, "width": (hi - lo) / F.lit(bins)}).drop("ends")

    placed = with_bins(df.filter(v.isNotNull()).select(v.alias("v")))
    first = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    edge = lambda k: F.col("lo") + k * F.col("width")
    counted = (
        placed.withColumn("b", first)
        .select(F.when(F.col("v") < edge(F.col("b")), F.col("b") - 1)
                .when((F.col("v") >= edge(F.col("b") + 1)) & (F.col("b") < bins - 1), F.col("b") + 1)
                .otherwise(F.col("b")).alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )
    axis = with_bins(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")))
    return join_small(axis, counted, "bin", "left", rows=bins).select(
        "bin", edge(F.col("bin")).alias("left_edge"), edge(F.col("bin") + 1).alias("right_edge"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def extents(df: DataFrame, time: str = "time") -> DataFrame:
    """Coordinate ranges and number of time steps (D11), one row."""
    return df.agg(
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
        F.min(time).alias("time_min"), F.max(time).alias("time_max"), F.count_distinct(time).alias("n_steps"))


Rule = tuple[float, float]


def check_ranges(df: DataFrame, rules: Mapping[str, Rule], strict_low: Sequence[str] = ()) -> DataFrame:
    """Whether each variable's minimum and maximum respect low <= v < high.

    Variables in `strict_low` need low < v. Variables the cube lacks are not checked.
    """
    present = {c: r for c, r in rules.items() if c in df.columns}
    ends = df.agg(*(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in present))

    def verdict(c: str, rule: Rule) -> Column:
        low = F.col(c)["lo"] > rule[0] if c in strict_low else F.col(c)["lo"] >= rule[0]
        return F.struct(F.lit(c).alias("rule"), F.col(c)["lo"].alias("observed_min"), F.col(c)["hi"].alias("observed_max"),
                        (low & (F.col(c)["hi"] < rule[1])).alias("ok"))

    return ends.select(F.explode(F.array(*(verdict(c, r) for c, r in present.items()))).alias("r")).select("r.*")


def validate_split(splits: DataFrame, n: int, declared: int) -> DataFrame:
    """Checks on all split members together (D15): `(check, observed, ok)`."""
    s = splits.agg(F.count("seq_start").alias("total"), F.count_distinct("seq_start").alias("distinct"),
                   F.min("seq_start").cast("long").alias("lowest"), F.max("seq_start").cast("long").alias("highest"))
    dup = F.col("total") - F.col("distinct")
    checks = [("duplicates", dup, dup == 0), ("lowest", F.col("lowest"), F.col("lowest") >= 0),
              ("highest", F.col("highest"), F.col("highest") < n), ("total", F.col("total"), F.col("total") == declared)]
    return s.select(F.explode(F.array(*(F.struct(F.lit(name).alias("check"), seen.alias("observed"), ok.alias("ok"))
                                        for name, seen, ok in checks))).alias("c")).select("c.*")


def split_summary(splits: DataFrame, first: int = 5) -> DataFrame:
    """Per split: size, share, range and the first members in order."""
    head = F.collect_list(F.when(F.col("pos") < first, F.struct("pos", "seq_start")))
    return splits.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq_start").alias("lowest"), F.max("seq_start").alias("highest"),
        F.array_sort(head).alias("head"),
    ).select("split", "n", _percent(F.col("n"), splits.agg(F.count(F.lit(1))).scalar()).alias("percent"), "lowest", "highest",
             F.transform("head", lambda h: h["seq_start"]).alias("sample"))


def cube_info(df: DataFrame, n_in: int, n_out: int) -> DataFrame:
    """Sizes of a cube and of the sequences it holds (D18), one row; `variables` lists its value columns."""
    values = [c for c in df.columns if c not in ("time", "t", "i", "j", "lat", "lon")]
    return df.agg((F.max("t") + 1).alias("n_frames"), (F.max("i") + 1).alias("n_lat"), (F.max("j") + 1).alias("n_lon"),
                  F.count(F.lit(1)).alias("n_rows")).select(
        "n_frames", "n_lat", "n_lon", "n_rows", F.lit(n_in).alias("input_len"), F.lit(n_out).alias("target_len"),
        F.greatest(F.lit(0), F.col("n_frames") - (n_in + n_out) + 1).alias("n_sequences"),
        F.lit(",".join(values)).alias("variables"))
