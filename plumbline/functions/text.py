"""Text tests and standard forms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(value: Column) -> Column:
    """True where the text is empty or spaces only, NULL where it is NULL."""
    return F.trim(value) == ""


def is_padded(value: Column) -> Column:
    """True where trimming would change the text."""
    return value != F.trim(value)


def bracketed(value: Column) -> Column:
    """Text between brackets, so that outer spaces show in a report."""
    return F.concat(F.lit("["), value, F.lit("]"))


def folded(value: Column) -> Column:
    """Lower case without outer spaces: the form variants are compared in."""
    return F.lower(F.trim(value))


def full_match(value: Column, pattern: str) -> Column:
    """Whole text matches the pattern; a trailing line break is not forgiven."""
    return value.rlike(rf"\A(?:{pattern})\z")


def mapped(value: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Look the value up in a mapping; NULL or ``default`` for values it does not list.

    The mapping is part of the plan; ``lookups.with_lookup`` joins long ones, with equal results.
    """
    entries = {k: v for k, v in mapping.items() if k is not None}
    if not entries:
        return F.lit(None) if default is None else default
    table = literal_map(entries)
    if default is None:
        return F.try_element_at(table, value)
    return F.when(F.map_contains_key(table, value), F.try_element_at(table, value)).otherwise(default)


def literal_map(entries: Mapping) -> Column:
    return F.create_map(*[F.lit(part) for entry in entries.items() for part in entry])
