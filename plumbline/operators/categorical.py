"""Category values: frequencies, variants, standard forms, corrections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import bracketed, folded, full_match
from plumbline.operators.lookups import with_lookup


def value_frequency(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """Values with a bracketed display and their row counts, most frequent first."""
    rows = df if where is None else df.filter(where)
    return (
        rows.groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select("value", bracketed(F.col("value")).alias("display"), "row_count")
        .orderBy(F.desc("row_count"), F.asc_nulls_last("value"))
    )


def variant_rows(
    df: DataFrame, column: str, canonical: Sequence[str], watch: Sequence[str] = ()
) -> DataFrame:
    """Rows that equal a canonical value only after folding, or that hold a watched value.

    A canonical value itself is never a variant, also where two of them fold alike.
    """
    value = F.col(column)
    rows = with_lookup(df, folded(value), {c.strip().lower(): True for c in canonical}, "_fold", "_folds")
    rows = with_lookup(rows, value, {c: True for c in canonical}, "_same", "_exact")
    is_variant = F.col("_folds") & ~F.col("_exact")
    if watch:
        rows = with_lookup(rows, value, {w: True for w in watch}, "_watch", "_watched")
        is_variant = is_variant | F.col("_watched")
    return rows.filter(is_variant).select(*df.columns)


def standardize_map(
    df: DataFrame,
    column: str,
    mapping: Mapping[str, str] | DataFrame,
    output: str,
    fold: bool = True,
    keep_unmapped: bool = False,
) -> DataFrame:
    """Add the standard form of a category beside the raw value.

    Unlisted values become NULL, or stay as trimmed text with ``keep_unmapped``. A mapping may
    be a table of value and standard; it is then joined, and Spark broadcasts it only while its
    size is under the session's threshold. Two standards for one value stop the job.
    """
    if isinstance(mapping, DataFrame):
        mapping = mapping.select("value", "standard")
    value = folded(F.col(column)) if fold else F.col(column)
    rows = with_lookup(df, value, mapping, "_std", "_listed")
    other = F.trim(F.col(column)) if keep_unmapped else F.lit(None)
    std = F.when(F.col("_listed"), F.col("_std")).otherwise(other)
    return rows.withColumn(output, std).drop("_std", "_listed")


def mapping_report(df: DataFrame, column: str, standard: str) -> DataFrame:
    """Raw values, what they became, and how many rows; unmapped values have no standard form."""
    return (
        df.groupBy(column, standard)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .withColumn("is_mapped", F.col(standard).isNotNull())
    )


def keyed_correction(
    df: DataFrame, key: str, column: str, fixes: Mapping | DataFrame, output: str
) -> DataFrame:
    """Override a value for listed keys; the raw column stays and ``<output>_corrected`` says so.

    A listed NULL takes the value away. Fixes may be a table with columns ``key`` and ``value``;
    two values for one key stop the job.
    """
    if isinstance(fixes, DataFrame):
        fixes = fixes.select("key", "value")
    rows = with_lookup(df, F.col(key), fixes, "_fix", "_listed")
    fixed = F.when(F.col("_listed"), F.col("_fix")).otherwise(F.col(column))
    return rows.select(*df.columns, fixed.alias(output), F.col("_listed").alias(f"{output}_corrected"))


def format_check(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Each value with its row count and whether the whole value has the expected shape."""
    return (
        df.groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .withColumn("matches_format", full_match(F.col("value"), pattern))
    )
