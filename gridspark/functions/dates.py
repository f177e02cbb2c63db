"""Calendar helpers and dates taken from file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridspark.functions.missing import _col

# How each family of files spells its date.
COMPACT = r"(\d{8})"
YEAR_M_DAY = r"(\d{4})m(\d{4})"
UNDERSCORED = r"(\d{4}_\d{2}_\d{2})"
DAILY_PRODUCT = r"^GC1SG1_(\d{8})\d+{suffix}\.nc$"


def base_name(path: Column | str) -> Column:
    """Last part of a path or URL."""
    return F.element_at(F.split(_col(path), "/"), -1)


def _date_of_digits(digits: Column) -> Column:
    """Eight digits as a date; NULL for an empty text or a day that does not exist."""
    parts = [F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)]
    return F.concat_ws("-", *parts).try_cast("date")


def compact_date(name: Column | str) -> Column:
    """First run of eight digits read as yyyyMMdd; NULL when there is none or it is no date."""
    return _date_of_digits(F.regexp_extract(_col(name), COMPACT, 1))


def year_m_day_date(name: Column | str) -> Column:
    """`2018m0131` style names."""
    return _date_of_digits(F.replace(F.regexp_extract(_col(name), YEAR_M_DAY, 0), F.lit("m"), F.lit("")))


def underscored_date(name: Column | str) -> Column:
    return _date_of_digits(F.replace(F.regexp_extract(_col(name), UNDERSCORED, 1), F.lit("_"), F.lit("")))


def product_date(name: Column | str, suffix: str) -> Column:
    """Strict daily-product template; `suffix` is literal text, brackets included."""
    pattern = DAILY_PRODUCT.replace("{suffix}", "\\Q" + suffix + "\\E")
    return _date_of_digits(F.regexp_extract(_col(name), pattern, 1))


def month_number_date(name: Column | str, year: int) -> Column:
    """First integer of the name as a month 1..12, dated the 15th of the configured year.

    Anything else is NULL, to be rejected by the caller (no "today" fallback).
    """
    month = F.regexp_extract(_col(name), r"(\d+)", 1).try_cast("int")
    return F.when(month.between(1, 12), F.make_date(F.lit(year), month, F.lit(15)))


def last_token_date(name: Column | str) -> Column:
    """Text after the last underscore, up to the first dot, read as an ISO or compact date."""
    token = F.element_at(F.split(F.element_at(F.split(_col(name), "_"), -1), r"\."), 1)
    return F.when(token.rlike(r"^\d{4}-\d{2}-\d{2}$"), token.try_cast("date")).when(
        token.rlike(r"^\d{8}$"), _date_of_digits(token)
    )


def file_date(name: Column | str, modified: Column | str | None = None) -> Column:
    """Ordered list of spellings, then the file's modification time if one is given.

    An eight-digit run decides alone: if it is present but no valid date, the file has no date.
    """
    name = _col(name)
    found = (
        F.when(F.regexp_extract(name, COMPACT, 1) != "", compact_date(name))
        .when(F.regexp_extract(name, YEAR_M_DAY, 0) != "", year_m_day_date(name))
        .when(F.regexp_extract(name, UNDERSCORED, 1) != "", underscored_date(name))
    )
    return found if modified is None else found.otherwise(F.to_date(_col(modified)))


def month_start(d: Column | str) -> Column:
    return F.trunc(_col(d), "MM")


def month_end(d: Column | str) -> Column:
    return F.last_day(_col(d))


def days_since_epoch(d: Column | str) -> Column:
    return F.unix_date(_col(d))


def date_of_days(n: Column | str) -> Column:
    """Whole or fractional days since 1970-01-01 to the date they fall on."""
    return F.date_from_unix_date(F.floor(_col(n)).cast("int"))
