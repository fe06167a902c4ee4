"""Ranges, precision and scale of numeric columns. Each profile is one aggregate pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.shaping import any_of, rows_from

EXACT_TYPE = "decimal(38,6)"


def _floating(df: DataFrame, column: Column) -> bool:
    return df.select(column).schema[0].dataType.simpleString() in ("float", "double")


def _report_type(df: DataFrame, columns: Sequence[Column]) -> str:
    """Type in which extremes of several columns are reported: double as soon as one is floating,
    so that infinity, NaN and tiny values show as they are; else a decimal of enough places."""
    if any(_floating(df, c) for c in columns):
        return "double"
    scales = [getattr(f.dataType, "scale", 0) for f in df.select(*columns).schema.fields]
    return EXACT_TYPE if max(scales, default=0) <= 6 else f"decimal(38,{max(scales)})"


def range_profile(df: DataFrame, columns: Sequence[str], low=None, high=None) -> DataFrame:
    """Minimum, maximum, zeros, negatives, rows below, at and above the bounds, and rows that are
    no finite number. NaN counts as greater than everything, as it sorts."""
    aggregates, kind = [], _report_type(df, [F.col(c) for c in columns])
    for i, c in enumerate(columns):
        v = F.col(c)
        tests = {"zero": v == 0, "negative": v < 0}
        whole = v if _floating(df, v) else F.lit(0.0)
        tests |= {"nan": F.isnan(whole), "infinite": F.abs(whole) == float("inf")}
        if low is not None:
            tests |= {"below_low": v < low, "at_low": v == low}
        if high is not None:
            tests |= {"above_high": v > high, "at_high": v == high}
        aggregates += [F.count(v).alias(f"testable{i}"), F.min(v).alias(f"min{i}"),
                       F.max(v).alias(f"max{i}")]
        aggregates += [F.count_if(t).alias(f"{name}{i}") for name, t in tests.items()]
    names = list(tests)
    one_row = df.agg(F.count(F.lit(1)).alias("total"), *aggregates)
    return rows_from(one_row, [
        {
            "column_name": F.lit(c),
            "total_rows": F.col("total"),
            "testable": F.col(f"testable{i}"),
            "minimum": F.col(f"min{i}").cast(kind),
            "maximum": F.col(f"max{i}").cast(kind),
            **{f"{name}_count": F.col(f"{name}{i}") for name in names},
        }
        for i, c in enumerate(columns)
    ])


def fractional_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs, values with a fraction, minimum and maximum per column."""
    aggregates, kind = [], _report_type(df, [F.col(c) for c in columns])
    for i, c in enumerate(columns):
        v = F.col(c)
        aggregates += [F.count(v).alias(f"n{i}"), F.count_if(v % 1 != 0).alias(f"f{i}"),
                       F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    one_row = df.agg(F.count(F.lit(1)).alias("total"), *aggregates)
    return rows_from(one_row, [
        {
            "column_name": F.lit(c),
            "null_count": F.col("total") - F.col(f"n{i}"),
            "fractional_count": F.col(f"f{i}"),
            "minimum": F.col(f"lo{i}").cast(kind),
            "maximum": F.col(f"hi{i}").cast(kind),
        }
        for i, c in enumerate(columns)
    ])


def scale_loss_profile(
    df: DataFrame, column: str, scales: Sequence[int] = (0, 1, 2, 3, 4), precision: int = 28
) -> DataFrame:
    """Values each decimal scale would change, and the smallest scale that changes none."""
    v = F.col(column)
    counts = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(v).alias("testable"),
        *[F.count_if(v != v.cast(f"decimal({precision},{s})")).alias(f"changed_at_{s}")
          for s in scales],
    )
    lossless = F.coalesce(*[F.when(F.col(f"changed_at_{s}") == 0, s) for s in sorted(scales)])
    return counts.withColumn("lossless_scale", lossless.cast("bigint"))


def precision_profile(df: DataFrame, columns: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """Largest absolute value of each column or expression, and the integer digits it needs (NULL
    when that value is no finite number)."""
    if not isinstance(columns, Mapping):
        columns = {c: F.col(c) for c in columns}
    names = list(columns)
    kind = _report_type(df, list(columns.values()))
    one_row = df.agg(*[F.max(F.abs(columns[c])).alias(f"m{i}") for i, c in enumerate(names)])

    def digits(value: Column) -> Column:
        whole = F.floor(value.cast("decimal(38,6)")) if kind != "double" else value - value % 1
        whole = whole.try_cast("decimal(38,0)")
        return F.when(whole == 0, 0).otherwise(F.length(whole.cast("string"))).cast("bigint")

    return rows_from(one_row, [
        {
            "column_name": F.lit(c),
            "max_abs": F.col(f"m{i}").cast(kind),
            "integer_digits": digits(F.col(f"m{i}")),
        }
        for i, c in enumerate(names)
    ])


def extreme_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All rows tied at a column's minimum or maximum, one output row per extreme they hold.

    The bounds are a one-row scalar subquery, so the second scan is a plain filter.
    """
    at_bound = {}
    for c in columns:
        at_bound[f"minimum {c}"] = F.col(c) == df.agg(F.min(c)).scalar()
        at_bound[f"maximum {c}"] = F.col(c) == df.agg(F.max(c)).scalar()
    labels = [F.when(test, F.lit(label)) for label, test in at_bound.items()]
    rows = df.filter(any_of(at_bound.values()))
    return rows.withColumn("extreme", F.explode(F.array_compact(F.array(*labels))))


def out_of_range_rows(df: DataFrame, value: Column | str, output: str, low=None, high=None):
    """Rows whose parsed value lies outside the bounds, with raw and parsed value."""
    v = F.col(value) if isinstance(value, str) else value
    outside = F.lit(False)
    if low is not None:
        outside = outside | (F.col(output) < low)
    if high is not None:
        outside = outside | (F.col(output) > high)
    return df.withColumn(output, v).filter(outside)


def threshold_crosstab(df: DataFrame, condition: Column, splits: Mapping[str, Column]) -> DataFrame:
    """Rows over a threshold, how they split, and whether the parts add up."""
    counts = df.agg(
        F.count_if(condition).alias("over_threshold"),
        *[F.count_if(condition & part).alias(name) for name, part in splits.items()],
    )
    parts = sum((F.col(name) for name in splits), F.lit(0))
    return counts.withColumn("reconciles", parts == F.col("over_threshold"))
