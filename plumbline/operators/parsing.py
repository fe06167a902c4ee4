"""What parses, what does not, and which reading it took."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.parsing import at_midnight, needed_fallback, parse_date_fallback


def parse_failures(df: DataFrame, column: str, parsed: Column, output: str) -> DataFrame:
    """Rows whose populated value has no parsed form; the (empty) parsed column is shown."""
    rows = df.withColumn(output, parsed)
    return rows.filter(F.col(column).isNotNull() & F.col(output).isNull())


def parse_failure_values(df: DataFrame, column: str, parsed: Column) -> DataFrame:
    """Failing values with their row counts, before or after a normalisation in ``parsed``."""
    return (
        df.filter(F.col(column).isNotNull() & parsed.isNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.desc("row_count"), "value")
    )


def parse_profile(df: DataFrame, column: str, stages: Mapping[str, Column]) -> DataFrame:
    """Rows each stage is the first to parse; with the failures they add up to the populated."""
    value = F.col(column)
    counts, earlier = [], F.lit(False)
    for name, parsed in stages.items():
        counts.append(F.count_if(parsed.isNotNull() & ~earlier).alias(name))
        earlier = earlier | parsed.isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(value).alias("populated"),
        *counts,
        F.count_if(value.isNotNull() & ~earlier).alias("failed_all"),
    )


def fallback_date_rows(df: DataFrame, column: str, output: str) -> DataFrame:
    """Rows whose date text only the month/day/year reading understands."""
    text = F.col(column)
    return df.filter(needed_fallback(text)).withColumn(output, parse_date_fallback(text))


def midnight_check(df: DataFrame, column: str) -> DataFrame:
    """Would a timestamp column lose anything as a date?"""
    ts = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(ts).alias("populated"),
        F.count_if(at_midnight(ts)).alias("at_midnight"),
        F.count_if(~at_midnight(ts)).alias("with_time"),
    )
