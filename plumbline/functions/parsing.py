"""Parse money, percent and date text; text that cannot be parsed becomes NULL, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date shapes accepted as year-month-day and as month/day/year.
TIME_PART = r"(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?"
YMD_SHAPE = rf"^\s*(\d{{4}})([-/ ])(\d{{1,2}})\2(\d{{1,2}}){TIME_PART}\s*$"
MDY_SHAPE = r"^\d{1,2}/\d{1,2}/\d{4}$"
MDY_FORMAT = "M/d/yyyy"


def to_decimal(value: Column, precision: int, scale: int) -> Column:
    return value.try_cast(f"decimal({precision},{scale})")


def strip_money(text: Column) -> Column:
    return F.regexp_replace(text, "[$,]", "")


def normalize_money(text: Column, precision: int = 18, scale: int = 2) -> Column:
    """Decimal of text which may carry ``$`` and thousands commas."""
    return to_decimal(strip_money(text), precision, scale)


def normalize_percent(text: Column, precision: int = 4, scale: int = 1) -> Column:
    """Decimal of text which may carry a percent sign."""
    return to_decimal(F.replace(text, F.lit("%"), F.lit("")), precision, scale)


def has_percent_sign(text: Column) -> Column:
    return F.instr(text, "%") > 0


def parse_ymd(text: Column) -> Column:
    """Date of text that is a full year, month and day, with or without a time of day.

    The shape is tested first because a plain cast also takes a bare year as a date.
    """
    dashed = F.regexp_replace(text, YMD_SHAPE, "$1-$3-$4")
    return F.when(text.rlike(YMD_SHAPE), dashed.try_cast("date"))


def parse_mdy(text: Column) -> Column:
    """Date of month/day/year text, with or without leading zeros."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(MDY_SHAPE), F.try_to_date(trimmed, MDY_FORMAT))


def parse_date_fallback(text: Column) -> Column:
    """Year-month-day first, then month/day/year."""
    return F.coalesce(parse_ymd(text), parse_mdy(text))


def needed_fallback(text: Column) -> Column:
    """True where only the month/day/year reading gives a date."""
    return parse_ymd(text).isNull() & parse_mdy(text).isNotNull()


def at_midnight(ts: Column) -> Column:
    """True where a timestamp has no time part, so that a date would hold the same."""
    return ts == F.date_trunc("day", ts)
