"""Cleaned tables: raw columns kept, standard columns added, every change or doubt flagged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.keys import dedup_exact


@dataclass(frozen=True)
class CleaningPlan:
    """Rules for one table.

    ``standard`` maps names of new columns to expressions over raw columns; ``derived`` maps
    further names to expressions that may use the standard ones. ``flags`` maps a code to the
    condition that sets it. Nothing replaces a raw column.
    """

    key: str | Sequence[str] | None
    standard: Mapping[str, Column]
    flags: Mapping[str, Column]
    derived: Mapping[str, Column] = field(default_factory=dict)


def flag_codes(flags: Mapping[str, Column]) -> Column:
    """Codes of the conditions that hold, in the order they are listed."""
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in flags.items()]))


def apply_plan(rows: DataFrame, plan: CleaningPlan) -> DataFrame:
    """Standard columns and flags without the duplicate step; narrow, no shuffle."""
    taken = set(rows.columns) & {*plan.standard, *plan.derived, "flags"}
    if taken:
        raise ValueError(f"raw columns would be replaced: {sorted(taken)}")
    cleaned = rows.withColumns(dict(plan.standard))
    if plan.derived:
        cleaned = cleaned.withColumns(dict(plan.derived))
    return cleaned.withColumn("flags", flag_codes(plan.flags))


def clean(rows: DataFrame, plan: CleaningPlan, on_conflict: str = "error") -> DataFrame:
    """Drop exact duplicates, then apply the plan; differing rows of one key stop the job."""
    return apply_plan(dedup_exact(rows, plan.key, on_conflict), plan)


def flag_counts(cleaned: DataFrame) -> DataFrame:
    """Rows per flag code."""
    return (
        cleaned.select(F.explode("flags").alias("flag"))
        .groupBy("flag")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
