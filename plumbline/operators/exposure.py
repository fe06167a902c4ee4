"""Amounts per payment status and the cost-exposure figures built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import folded

# Payment statuses that make up incurred cost, and those reported apart.
INCURRED_STATUSES = ("paid", "approved", "applied")
PENDING_STATUSES = ("pending",)
MONEY = "decimal(38,2)"


def status_exposure(df: DataFrame, status: str, amount: Column) -> DataFrame:
    """Rows and net amount per standard status; credits stay negative."""
    return (
        df.groupBy(folded(F.col(status)).alias("status"))
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum(amount).cast(MONEY).alias("net_amount"))
        .orderBy(F.desc_nulls_last("net_amount"), F.asc_nulls_last("status"))
    )


def exposure_summary(
    df: DataFrame,
    status: str,
    amount: Column,
    incurred: Sequence[str] = INCURRED_STATUSES,
    pending: Sequence[str] = PENDING_STATUSES,
) -> DataFrame:
    """Incurred and pending amounts, their sum as the maximum, and what neither list covers."""
    std = folded(F.col(status))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0)).cast(MONEY)

    sums = df.agg(
        total(std.isin(*incurred)).alias("incurred"),
        total(std.isin(*pending)).alias("pending"),
        F.coalesce(F.sum(amount), F.lit(0)).cast(MONEY).alias("all_statuses"),
    )
    maximum = (F.col("incurred") + F.col("pending")).cast(MONEY)
    return sums.withColumn("maximum", maximum).withColumn(
        "unassigned", (F.col("all_statuses") - F.col("maximum")).cast(MONEY)
    )
