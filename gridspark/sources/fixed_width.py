"""Fixed-width text grids and their diagnosis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.functions.names import latitude_label
from gridspark.sources.lines import numbered_lines

MISSING = 999


@dataclass(frozen=True)
class TextGrid:
    """Layout of the text: the defaults are the monthly ozone product."""

    header: int = 3
    n_lat: int = 120
    n_lon: int = 288
    per_line: int = 25
    width: int = 3
    scale: float = 10.0
    lat0: float = -59.5
    dlat: float = 1.0
    lon0: float = -179.375
    dlon: float = 1.25

    @property
    def lines_per_lat(self) -> int:
        return -(-self.n_lon // self.per_line)


def _stripped(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"^\s+", ""), r"\s+$", "")


def fixed_int(text: Column, k: Column, width: int = 3) -> Column:
    """The k-th fixed-width integer of a text; 999 when it is cut short or no number."""
    piece = F.substring(text, k * width + 1, F.lit(width))
    whole = F.length(piece) == width
    return F.coalesce(F.when(whole, piece.try_cast("int")), F.lit(MISSING))


def parse_text_grid(files: DataFrame, layout: TextGrid = TextGrid(), text: str = "value",
                    keys: Sequence[str] = ("path",)) -> DataFrame:
    """Text of one grid per row to cells `(keys.., i, j, lat, lon, value)`.

    A row expands into its own cells, all of them, whatever lines are missing: no join, no
    shuffle. Lines are stripped before slicing, and lines past the end read as missing.
    """
    g = layout
    lines = F.split(F.col(text), "\r?\n")
    cell = F.sequence(F.lit(0), F.lit(g.n_lat * g.n_lon - 1))
    per_lat = g.lines_per_lat
    row = files.select(*keys, F.transform(F.slice(lines, F.lit(g.header + 1), F.lit(g.n_lat * per_lat)), _stripped).alias("_lines"))
    number = F.col("_line") - 1
    numbered = row.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(g.n_lat * per_lat))).alias("_line"), F.col("_lines")).select(
        *keys, F.floor(number / per_lat).cast("int").alias("i"), F.pmod(number, F.lit(per_lat)).alias("_row"),
        F.coalesce(F.get(F.col("_lines"), number), F.lit("")).alias("_text"))
    return _cells(numbered, g, keys)


def _cells(numbered: DataFrame, g: TextGrid, keys: Sequence[str]) -> DataFrame:
    """Cells of stripped lines `(keys.., i, _row, _text)`, where `_row` counts the lines of a latitude."""
    last = F.least(F.lit(g.per_line), F.lit(g.n_lon) - F.col("_row") * g.per_line)
    cells = numbered.select(*keys, "i", "_row", "_text", F.explode(F.sequence(F.lit(0), (last - 1).cast("int"))).alias("_k")).select(
        *keys, "i", (F.col("_row") * g.per_line + F.col("_k")).cast("int").alias("j"), fixed_int(F.col("_text"), F.col("_k"), g.width).alias("_raw"))
    return cells.select(
        *keys, "i", "j", F.round(F.lit(g.lat0) + F.col("i") * g.dlat, 3).alias("lat"), F.round(F.lit(g.lon0) + F.col("j") * g.dlon, 3).alias("lon"),
        (F.nullif(F.col("_raw"), F.lit(MISSING)) / F.lit(g.scale)).alias("value"))


def parse_grid_lines(lines: DataFrame, layout: TextGrid = TextGrid()) -> DataFrame:
    """Numbered lines of files that hold one grid after the other to cells `(path, grid, i, j, lat, lon, value)`.

    A line knows its grid, latitude and longitudes from its number, so files of any length are parsed line by line
    without a shuffle. Lines past the end of the last grid have no row, which is a missing cell.
    """
    g = layout
    whole = g.header + g.n_lat * g.lines_per_lat
    inside = F.col("line") % whole - g.header
    numbered = lines.filter(inside >= 0).select(
        "path", F.expr(f"line div {whole}").cast("int").alias("grid"), F.floor(inside / g.lines_per_lat).cast("int").alias("i"),
        (inside % g.lines_per_lat).cast("int").alias("_row"), _stripped(F.col("value")).alias("_text"))
    return _cells(numbered, g, ["path", "grid"])


def read_grids(spark: SparkSession, path: str, layout: TextGrid = TextGrid()) -> DataFrame:
    """Files of many grids each (A4), cut into pieces by bytes wherever Spark likes."""
    return parse_grid_lines(numbered_lines(spark, path), layout)


def read_fixed_width_grid(spark: SparkSession, path: str, layout: TextGrid = TextGrid()) -> DataFrame:
    """Grid files of a folder or glob (A4). A file is one grid, a few dozen kilobytes by its format."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_text_grid(files, layout)


def diagnose_text(files: DataFrame, text: str = "value", keys: Sequence[str] = ("path",)) -> DataFrame:
    """What a grid text looks like (D19), one row per text, no shuffle.

    Number of lines; where data seems to start (first of ten lines longer than 200 characters
    with a digit, else the fourth); length, digits and leading blank of five lines from there;
    the first ten numbers; the latitude label of the second line; the first five lines of all.
    """
    # a final line end closes the last line and opens none
    body = F.regexp_replace(F.col(text), r"\r?\n\z", "")
    cut = files.select(*keys, F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(body, "\r?\n")).alias("_all"))
    # data starts within ten lines, and five lines from there are looked at
    df = cut.select(*keys, F.size("_all").alias("n_lines"), F.transform(F.slice("_all", 1, 15), lambda s: F.regexp_replace(s, r"\s+$", "")).alias("_lines"))
    looks_like_data = lambda s: (F.length(s) > 200) & s.rlike(r"\d")
    hits = F.transform(F.slice("_lines", 1, 10), looks_like_data)
    found = F.array_position(hits, F.lit(True))
    df = df.withColumn("data_start", F.when(found > 0, found.cast("int")).otherwise(4))
    at = F.get(F.col("_lines"), F.col("data_start") - 1)
    data = F.slice(F.col("_lines"), F.col("data_start"), F.lit(5))
    sample = F.regexp_replace(at, r"^\s+", "")
    piece = lambda k: F.substring(sample, k * 3 + 1, F.lit(3))
    values = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(9)), lambda k: F.length(piece(k)) == 3), lambda k: piece(k).try_cast("int"))
    return df.select(
        *keys, "n_lines", "data_start", F.transform(data, lambda s: F.length(s)).alias("line_lengths"),
        F.transform(data, lambda s: F.length(F.regexp_replace(s, r"\D", ""))).alias("digit_counts"),
        F.transform(data, lambda s: s.startswith(" ")).alias("leading_blanks"),
        F.filter(values, lambda v: v.isNotNull()).alias("sample_values"),
        latitude_label(F.get(F.col("_lines"), F.col("data_start"))).alias("lat_label"), F.slice("_lines", 1, 5).alias("head"))
