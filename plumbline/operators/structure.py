"""Schema and first look."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.parsing import parse_ymd
from plumbline.operators.shaping import as_list, rows_from, sql_type


def schema_profile(df: DataFrame) -> DataFrame:
    """Name, type and populated rows of every column, counted in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count(F.col(f.name)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)],
    )
    return rows_from(
        counts,
        [
            {
                "position": F.lit(i + 1).cast("bigint"),
                "column_name": F.lit(f.name),
                "column_type": F.lit(sql_type(f.dataType)),
                "populated": F.col(f"n{i}"),
                "total_rows": F.col("total_rows"),
            }
            for i, f in enumerate(df.schema.fields)
        ],
    )


def preview(df: DataFrame, n: int, key: str | list[str]) -> DataFrame:
    """First ``n`` rows by key: each task keeps ``n`` rows, so nothing is sorted as a whole."""
    return df.orderBy(*as_list(key)).limit(n)


def type_parse_counts(df: DataFrame, column: str, target: str) -> DataFrame:
    """Type found by the reader, and how many populated values convert to ``target``.

    Text is a date only with a full year, month and day, as ``parse_ymd`` has it.
    """
    value = F.col(column)
    is_text = isinstance(df.schema[column].dataType, T.StringType)
    parsed = parse_ymd(value) if target == "date" and is_text else value.try_cast(target)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(value).alias("populated"),
        F.count(parsed).alias("parsed"),
        F.count_if(value.isNotNull() & parsed.isNull()).alias("failed"),
    ).select(F.lit(sql_type(df.schema[column].dataType)).alias("inferred_type"), "*")
