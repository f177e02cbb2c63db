"""File-name and text helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridspark.functions.missing import _col


def clean_path(path: Column | str) -> Column:
    """`[ND]` becomes `_ND_`, any other bracket becomes an underscore."""
    return F.translate(_col(path), "[]", "__")


def in_product(name: Column | str, prefix: str, suffix: str) -> Column:
    """Prefix and suffix match."""
    name = _col(name)
    return name.startswith(prefix) & name.endswith(suffix)


def daily_name(prefix: str, day: Column | str, suffix: str) -> Column:
    """`<prefix>yyyyMMdd<suffix>`."""
    return F.concat(F.lit(prefix), F.date_format(_col(day), "yyyyMMdd"), F.lit(suffix))


def monthly_name(day: Column | str, suffix: str) -> Column:
    """`yyyyMM<suffix>`."""
    return F.concat(F.date_format(_col(day), "yyyyMM"), F.lit(suffix))


def day_folder(base: str, day: Column | str) -> Column:
    """`base/yyyy/MM/dd`."""
    return F.concat_ws("/", F.lit(base), F.date_format(_col(day), "yyyy/MM/dd"))


# Fixed value: how a grid text labels a latitude.
LATITUDE_LABEL = r"lat\s*=\s*([-+]?\d*\.?\d+)"


def latitude_label(line: Column | str) -> Column:
    """Number after `lat =` in a line, else NULL."""
    return F.regexp_extract(_col(line), LATITUDE_LABEL, 1).try_cast("double")


def mebibytes(n: Column | str) -> Column:
    return _col(n) / F.lit(1024.0 * 1024.0)


def gibibytes(n: Column | str) -> Column:
    return mebibytes(n) / F.lit(1024.0)


def percent(part: Column | str, whole: Column | str) -> Column:
    """Share in percent; NULL for an empty whole."""
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double")) * F.lit(100.0)
