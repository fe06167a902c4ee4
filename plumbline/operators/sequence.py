"""Checks on ordered histories, for a whole table or per entity."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordering import with_neighbors
from plumbline.operators.shaping import as_list
from plumbline.sources.tables import written


def block_starts(
    df: DataFrame, order: Sequence[str], column: str, ranges: int | None = None
) -> DataFrame:
    """Rows where a populated value differs from the populated value before; first row included."""
    populated = df.filter(F.col(column).isNotNull())
    linked = with_neighbors(populated, order, previous={"previous_value": column}, ranges=ranges)
    return linked.filter(~F.col("previous_value").eqNullSafe(F.col(column)))


def neighbor_context(
    df: DataFrame,
    order: Sequence[str],
    column: str,
    where: Column | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Values before and after over all rows; ``where`` selects rows only afterwards."""
    linked = with_neighbors(
        df, order, previous={"previous_value": column}, following={"next_value": column},
        ranges=ranges,
    )
    return linked if where is None else linked.filter(where)


def key_window_rows(df: DataFrame, key: str, low, high) -> DataFrame:
    """Rows of a closed key interval in key order; the filter reaches the scan."""
    return df.filter(F.col(key).between(low, high)).orderBy(key)


def monotonic_violations(
    df: DataFrame,
    entity: str,
    order: Sequence[str],
    column: str,
    ranges: int | None = None,
) -> DataFrame:
    """Rows whose value falls below the value before it in the same entity's history."""
    linked = with_neighbors(
        df, order, previous={"previous_value": column}, by=[entity], ranges=ranges
    )
    fell = linked.filter(F.col(column) < F.col("previous_value"))
    return fell.withColumn("decrease", F.col("previous_value") - F.col(column))


def affected_histories(
    df: DataFrame,
    entity: str,
    order: Sequence[str],
    column: str,
    at: Mapping[str, dt.date] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Full history of each entity with a fall, or with a fall on a given date (``at``).

    The falls come from the narrow columns; the entities found are written, so that Spark knows
    their size and broadcasts a short list instead of shuffling the wide rows.
    """
    narrow = df.select(*dict.fromkeys([entity, *order, column, *(at or {})]))
    fell = monotonic_violations(narrow, entity, order, column, ranges)
    for date_column, day in (at or {}).items():
        fell = fell.filter(F.col(date_column) == F.lit(day))
    entities = written(fell.select(F.col(entity).alias("_entity")).distinct(), "affected-entities")
    return df.join(entities, F.col(entity) == F.col("_entity"), "left_semi")


def entity_history(
    df: DataFrame,
    entity: str,
    value,
    order: str | Sequence[str],
    variance: tuple[str, str] | None = None,
) -> DataFrame:
    """One entity's rows in order, with actual minus planned where a pair is named."""
    rows = df.filter(F.col(entity) == F.lit(value))
    if variance:
        actual, planned = variance
        rows = rows.withColumn("variance", F.col(actual) - F.col(planned))
    return rows.orderBy(*as_list(order))


def variance_profile(df: DataFrame, row_id: str, actual: str, planned: str) -> DataFrame:
    """Updates ahead of, on and behind plan, after equal rows are counted once."""
    unique = df.select(row_id, actual, planned).distinct()
    variance = F.col(actual) - F.col(planned)
    return unique.agg(
        F.count(F.lit(1)).alias("unique_rows"),
        F.count(variance).alias("testable"),
        F.count_if(variance > 0).alias("ahead"),
        F.count_if(variance == 0).alias("on_plan"),
        F.count_if(variance < 0).alias("behind"),
        F.min(variance).alias("min_variance"),
        F.max(variance).alias("max_variance"),
    )
