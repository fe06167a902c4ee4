"""Date ranges, relations between dates, and facts against planned timelines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordering import with_row_numbers
from plumbline.operators.referential import unique_dimension
from plumbline.operators.shaping import as_list, rows_from
from plumbline.sources.tables import written


def date_range_profile(
    df: DataFrame, columns: Mapping[str, Column], cutoff: dt.date | None = None
) -> DataFrame:
    """Earliest and latest date, NULLs, and rows after the cutoff, for several dates at once."""
    aggregates = []
    for i, date in enumerate(columns.values()):
        aggregates += [F.count(date).alias(f"n{i}"), F.min(date).alias(f"lo{i}"),
                       F.max(date).alias(f"hi{i}")]
        if cutoff is not None:
            aggregates.append(F.count_if(date > F.lit(cutoff)).alias(f"late{i}"))
    one_row = df.agg(F.count(F.lit(1)).alias("total"), *aggregates)
    return rows_from(one_row, [
        {
            "column_name": F.lit(name),
            "null_count": F.col("total") - F.col(f"n{i}"),
            "earliest": F.col(f"lo{i}"),
            "latest": F.col(f"hi{i}"),
            **({"after_cutoff": F.col(f"late{i}")} if cutoff is not None else {}),
        }
        for i, name in enumerate(columns)
    ])


def date_relation_profile(
    df: DataFrame, date: Column, anchor: Column, cutoff: dt.date | None = None
) -> DataFrame:
    """Dates before, on and after their anchor date, missing ones, and the overall range."""
    aggregates = [
        F.count(F.lit(1)).alias("total_rows"),
        F.count(date).alias("populated"),
        F.count_if(date.isNull()).alias("null_count"),
        F.min(date).alias("earliest"),
        F.max(date).alias("latest"),
        F.count_if(date < anchor).alias("before_anchor"),
        F.count_if(date == anchor).alias("on_anchor"),
        F.count_if(date > anchor).alias("after_anchor"),
    ]
    if cutoff is not None:
        aggregates.append(F.count_if(date > F.lit(cutoff)).alias("after_cutoff"))
    return df.agg(*aggregates)


def date_gap_rows(df: DataFrame, date: Column, anchor: Column) -> DataFrame:
    """Rows whose date precedes the anchor date, with the gap in days."""
    return df.filter(date < anchor).withColumn(
        "gap_days", F.datediff(anchor, date).cast("bigint"))


# Facts are folded before a join if they come to at most this share of their rows.
FOLD_AT = 0.5


def _dated_facts(
    facts: DataFrame, dim: DataFrame, keys: Sequence[str], columns: Sequence[str], how: str,
    fold: bool | None,
) -> DataFrame:
    """Facts per key and date with their dimension row; ``n`` is the number of facts.

    Where many facts share key and date, they are folded first, so that a hot key brings one row per date
    to the join. Where hardly any do, folding would only shuffle them once more: they are joined as they
    are, a hot key is split by the skew join, and what follows folds them. The counts are the same. ``fold=None``
    lets the data decide, by an approximate distinct count over all facts, which is one pass without a shuffle.
    """
    if fold is None:
        seen = facts.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*columns))).first()
        fold = seen[1] <= FOLD_AT * seen[0]
    if fold:
        facts = facts.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    else:
        facts = facts.select(*columns, F.lit(1).cast("bigint").alias("n"))
    return facts.join(unique_dimension(dim, keys), list(keys), how)


def timeline_violations(
    facts: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    date: str,
    before: Mapping[str, str],
    after: Mapping[str, str],
    cutoff: dt.date | None = None,
    fold: bool | None = None,
) -> DataFrame:
    """Facts dated before a start, after an end, or after the cutoff.

    ``before`` and ``after`` map a result name to the dimension date. A missing date counts
    nowhere. Facts without a dimension row stay in the total. ``fold`` as in ``overrun_by_group``.
    """
    keys = as_list(on)
    bounds = list(dict.fromkeys([*before.values(), *after.values()]))
    timeline = _dated_facts(facts, dim.select(*keys, *bounds), keys, [*keys, date], "left", fold)
    d = F.col(date)
    tests = {"total_rows": F.lit(True)}
    tests |= {name: d < F.col(c) for name, c in before.items()}
    tests |= {name: d > F.col(c) for name, c in after.items()}
    if cutoff is not None:
        tests["after_cutoff"] = d > F.lit(cutoff)
    return timeline.agg(*[
        F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("bigint").alias(name)
        for name, test in tests.items()
    ])


def overrun_by_group(
    facts: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    date: str,
    end: str,
    group: Sequence[str],
    k: int | None = None,
    fold: bool | None = None,
) -> DataFrame:
    """Per group: facts after the planned end, first and last such date, longest overrun.

    ``fold`` counts the facts of a key and date before the join (True) or after it (False); by default a
    pass over the facts decides, at once. The result is the same.
    """
    keys = as_list(on)
    of_dim = list(dict.fromkeys([*keys, end, *[g for g in group if g in dim.columns]]))
    of_facts = list(dict.fromkeys([*keys, date, *[g for g in group if g not in of_dim]]))
    dated = _dated_facts(facts, dim.select(*of_dim), keys, of_facts, "inner", fold)
    summary = dated.filter(F.col(date) > F.col(end)).groupBy(*group).agg(
        F.sum("n").cast("bigint").alias("late_rows"),
        F.min(date).alias("first_late_date"),
        F.max(date).alias("last_late_date"),
        F.max(F.datediff(date, end)).cast("bigint").alias("max_days_beyond"),
    )
    ordered = summary.orderBy(F.desc("late_rows"), *group)
    return ordered if k is None else ordered.limit(k)


def weekday_distribution(df: DataFrame, entity: str, date: Column) -> DataFrame:
    """Distinct entity dates per ISO weekday (Monday is 1)."""
    days = df.select(F.col(entity), date.alias("day")).filter(F.col("day").isNotNull()).distinct()
    return (
        days.groupBy((F.weekday("day") + 1).cast("bigint").alias("weekday_number"))
        .agg(F.count(F.lit(1)).alias("entity_dates"), F.min("day").alias("_any"))
        .select(
            "weekday_number",
            F.date_format("_any", "EEEE").alias("weekday_name"),
            "entity_dates",
        )
        .orderBy("weekday_number")
    )


def entity_date_rollup(
    df: DataFrame,
    entity: str,
    date: str,
    distinct_id: str,
    lists: Mapping[str, str],
    sums: Mapping[str, Column],
) -> DataFrame:
    """Entity dates with several rows: counts, distinct ids, value lists, sums.

    ``lists`` maps an output to a category column whose distinct values are listed in order,
    NULL last. All value combinations are first folded into one row each, so a hot entity date
    brings its distinct combinations, not its rows, to one task. For a column without a bounded
    set of values use ``entity_date_values``.
    """
    details = list(dict.fromkeys([distinct_id, *lists.values()]))
    folded = df.groupBy(entity, date, *details).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(sums.values())]
    )

    def listed(column: str):
        has_null = F.max(F.col(column).isNull())
        values = F.array_sort(F.collect_set(column))
        with_null = F.concat(values, F.array(F.lit(None).cast(df.schema[column].dataType)))
        return F.when(has_null, with_null).otherwise(values)

    rollup = folded.groupBy(entity, date).agg(
        F.sum("n").cast("bigint").alias("row_count"),
        F.count_distinct(distinct_id).alias("distinct_ids"),
        *[listed(c).alias(name) for name, c in lists.items()],
        *[F.sum(f"s{i}").alias(name) for i, name in enumerate(sums)],
    )
    return rollup.filter(F.col("row_count") > 1)


def entity_date_values(df: DataFrame, entity: str, date: str, column: str) -> DataFrame:
    """The value lists of ``entity_date_rollup`` in long form: one row per distinct value."""
    return df.groupBy(entity, date, column).agg(F.count(F.lit(1)).alias("row_count"))


def entity_date_pages(df: DataFrame, entity: str, date: str, column: str, page_size: int = 1000) -> DataFrame:
    """The distinct values of each entity date as numbered pages, in order, NULL last.

    ``entity, date, page, values``: pages count from 0 and hold ``page_size`` values, the last one what is left. Values
    are numbered in ranges, so an entity date with any number of them is never in one row or one task.
    """
    if page_size < 1:
        raise ValueError("a page holds at least one value")
    values = written(df.select(entity, date, column).distinct(), "entity-date-values")
    numbered = with_row_numbers(values, [column], "_place", by=[entity, date])
    placed = numbered.select(entity, date, F.expr(f"(_place - 1) div {page_size}").alias("page"),
                             F.struct(F.col("_place"), F.col(column).alias("value")).alias("_v"))
    pages = placed.groupBy(entity, date, "page").agg(F.array_sort(F.collect_list("_v")).alias("_vs"))
    return pages.select(entity, date, "page", F.transform("_vs", lambda v: v["value"]).alias("values"))
