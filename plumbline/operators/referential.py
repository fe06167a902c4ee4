"""Keys across tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.shaping import all_of, any_of, as_list
from plumbline.sources.tables import written


def _child_groups(child: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per child key before any join: a hot key joins once, not once per row."""
    return child.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))


def orphan_counts(
    child: DataFrame,
    parent: DataFrame,
    keys: str | Sequence[str],
    parent_keys: str | Sequence[str] | None = None,
    include_null: bool = True,
) -> DataFrame:
    """Child keys with no parent and the rows they hold. A key with a NULL part has no parent.

    Both sides are one row per key before they meet, on the exchange the join uses anyway.
    """
    keys = as_list(keys)
    parents = parent.select(
        *[F.col(p).alias(k) for p, k in zip(as_list(parent_keys or keys), keys, strict=True)]
    ).distinct()
    groups = _child_groups(child, keys)
    if not include_null:
        groups = groups.filter(all_of(F.col(k).isNotNull() for k in keys))
    return groups.join(parents, keys, "left_anti")


def orphan_keys(
    child: DataFrame,
    parent: DataFrame,
    keys: str | Sequence[str],
    parent_keys: str | Sequence[str] | None = None,
    include_null: bool = False,
) -> DataFrame:
    """Distinct child keys with no parent."""
    orphans = orphan_counts(child, parent, keys, parent_keys, include_null)
    return orphans.select(*as_list(keys))


def standardized_orphans(
    child: DataFrame,
    parent: DataFrame,
    keys: Mapping[str, tuple[Column, Column]],
) -> DataFrame:
    """Orphans left after both sides are put into standard form.

    ``keys`` maps each output key to its standard form in the child and in the parent.
    """
    left = child.select(*[c.alias(k) for k, (c, _) in keys.items()])
    right = parent.select(*[p.alias(k) for k, (_, p) in keys.items()])
    return orphan_keys(left, right, list(keys), include_null=True)


def key_presence(tables: Mapping[str, tuple[DataFrame, str]], value) -> DataFrame:
    """Rows of one key value in several tables."""
    counts = [
        df.filter(F.col(column) == F.lit(value)).agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count")
        )
        for name, (df, column) in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts)


def lookup_rows(
    df: DataFrame, column: str, values: Sequence | DataFrame, select: Sequence[str] = ()
) -> DataFrame:
    """Rows of listed keys, their columns in place. A list becomes a filter that reaches the scan
    (beyond a few hundred values Spark tests a hash set), a table a semi join."""
    if not isinstance(values, DataFrame):
        found = df.filter(F.col(column).isin(*dict.fromkeys(values)))
    else:
        keys = written(values.select(F.col(values.columns[0]).alias("_key")).distinct(), "keys")
        found = df.join(keys, F.col(column) == F.col("_key"), "left_semi")
    return found.select(*select) if select else found


def unique_dimension(dim: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """One row per key of a dimension with exact duplicates; differing rows stop the job.

    Rows with a NULL part in their key can join nothing and are left out.
    Grouping on the key alone lets the join that follows reuse the exchange, and plain minima
    and maxima keep numbers and dates in hash aggregation.
    """
    keys = as_list(keys)
    rest = [c for c in dim.columns if c not in keys]
    dim = dim.dropna(subset=keys)
    if not rest:
        return dim.distinct()
    aggregates = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(rest):
        aggregates += [F.min(c).alias(f"_lo{i}"), F.max(c).alias(f"_hi{i}"),
                       F.count(c).alias(f"_n{i}")]
    groups = dim.groupBy(*keys).agg(*aggregates)
    differs = any_of(
        (F.col(f"_lo{i}") != F.col(f"_hi{i}"))
        | ((F.col(f"_n{i}") > 0) & (F.col(f"_n{i}") < F.col("_n")))
        for i in range(len(rest))
    )
    shown = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    error = F.raise_error(F.concat(F.lit("differing dimension rows for "), shown))
    return groups.select(
        *keys,
        *[F.when(differs, error.cast(dim.schema[c].dataType)).otherwise(F.col(f"_lo{i}")).alias(c)
          for i, c in enumerate(rest)],
    )


def enrich_join(
    facts: DataFrame, dim: DataFrame, keys: str | Sequence[str], how: str = "inner"
) -> DataFrame:
    """Facts with the attributes of a de-duplicated dimension.

    Each fact meets at most one dimension row, so an inner join can drop facts but not repeat
    them; ``enrich_report`` counts the dropped ones. The reduced dimension is written first: its
    rows are checked once, Spark knows its size and broadcasts it only below the session's
    threshold, and otherwise both join sides are plain exchanges, which is what the skew join
    needs to split a hot key.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    return facts.join(written(unique_dimension(dim, keys), "dimension"), as_list(keys), how)


def enrich_report(facts: DataFrame, dim: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Facts with and without a dimension row: the row-count guard of ``enrich_join``."""
    keys = as_list(keys)
    parents = dim.select(*keys).distinct().withColumn("_found", F.lit(True))
    groups = _child_groups(facts, keys).join(parents, keys, "left")
    rows = F.col("row_count")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, rows)), F.lit(0)).cast("bigint")

    return groups.agg(
        total(F.lit(True)).alias("fact_rows"),
        total(F.col("_found")).alias("matched_rows"),
        total(F.col("_found").isNull()).alias("unmatched_rows"),
    )
