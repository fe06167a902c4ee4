"""Missing, blank and padded values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import is_blank, is_padded
from plumbline.operators.shaping import rows_from, text_columns


def _count_per_column(df: DataFrame, columns: Sequence[str], name: str, test) -> DataFrame:
    """One aggregate over all columns, then one report row per column."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(test(F.col(c))).alias(f"n{i}") for i, c in enumerate(columns)],
    )
    return rows_from(
        counts,
        [
            {
                "column_name": F.lit(c),
                "total_rows": F.col("total"),
                name: F.col(f"n{i}"),
            }
            for i, c in enumerate(columns)
        ],
    )


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _count_per_column(df, columns or df.columns, "null_count", Column.isNull)


def blank_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Empty or space-only values of each text column."""
    return _count_per_column(df, columns or text_columns(df), "blank_count", is_blank)


def whitespace_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Values of each text column that trimming would change."""
    return _count_per_column(df, columns or text_columns(df), "padded_count", is_padded)


def missing_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def missing_by_group(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Missing values per category, to tell an expected absence from a defect."""
    return missing_rows(df, column).groupBy(*by).agg(F.count(F.lit(1)).alias("missing_rows"))
