"""Keys, grain and duplicates.

Every distinct count here is a group-by on the key followed by a count of the groups. Map-side
aggregation folds a hot key into one row per task before the shuffle, and one pass over the
groups yields all the figures, without the row expansion of several DISTINCT aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import is_blank
from plumbline.operators.shaping import all_of, as_list, null_safe_on
from plumbline.sources.tables import written


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def key_profile(df: DataFrame, key: str, long_text: bool = False) -> DataFrame:
    """Rows, populated, distinct, NULL and blank keys, and rows beyond the first of their key.

    With ``long_text`` the shuffle carries a 256-bit digest of each key instead of the key.
    """
    k, n = F.col(key), F.col("n")
    is_text = isinstance(df.schema[key].dataType, T.StringType)
    blank = is_blank(k) if is_text else F.lit(False)
    if long_text:
        df = df.select(F.when(is_blank(k), F.lit("")).otherwise(F.sha2(key, 256)).alias("digest"),
                       F.when(is_blank(k), F.sha2(key, 256)).alias("blanks"))
        groups = df.groupBy("digest", "blanks").agg(F.count(F.lit(1)).alias("n"))
        groups = groups.withColumnRenamed("digest", key)
    else:
        groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("bigint")

    return groups.agg(
        total(F.lit(True)).alias("row_count"),
        total(k.isNotNull()).alias("non_null_keys"),
        F.count(k).alias("distinct_keys"),
        total(k.isNull()).alias("null_keys"),
        total(blank).alias("blank_keys"),
        F.coalesce(F.sum(F.when(k.isNotNull(), n - 1)), F.lit(0))
        .cast("bigint")
        .alias("surplus_rows"),
    )


def composite_key_profile(df: DataFrame, keysets: Sequence[Sequence[str]]) -> DataFrame:
    """Rows and distinct values of each candidate key.

    A single-column key counts populated values; a row of several columns counts even where
    parts are NULL. A key set within another one is counted from the groups of that one, so
    nested sets share one scan of the table.
    """
    sets = [list(columns) for columns in keysets]
    widest = {i: max((j for j in range(len(sets)) if set(sets[i]) <= set(sets[j])),
                     key=lambda j: (len(set(sets[j])), -j)) for i in range(len(sets))}

    def folded(columns: Sequence[str], rows: DataFrame, weight: Column) -> DataFrame:
        return rows.groupBy(*dict.fromkeys(columns)).agg(F.sum(weight).alias("n"))

    def profile(i: int) -> DataFrame:
        columns = sets[i]
        groups = folded(sets[widest[i]], df.select(*dict.fromkeys(sets[widest[i]])), F.lit(1))
        if widest[i] != i:
            groups = folded(columns, groups, F.col("n"))
        distinct = F.count(F.col(columns[0]) if len(columns) == 1 else F.lit(1))
        return groups.agg(
            F.lit(",".join(columns)).alias("key_columns"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("row_count"),
            distinct.alias("distinct_keys"),
            F.count_if(F.col("n") > 1).alias("repeated_keys"),
        )

    return reduce(DataFrame.unionAll, [profile(i) for i in range(len(sets))])


def duplicate_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keys found on more than one row."""
    groups = df.groupBy(*as_list(keys)).agg(F.count(F.lit(1)).alias("occurrences"))
    return groups.filter(F.col("occurrences") > 1)


def duplicate_rows(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """All rows behind repeated keys; a NULL key counts as a key.

    A first pass over the keys alone writes the repeated ones. Their size is then known, so with
    few of them Spark broadcasts the list and the wide rows are filtered without a shuffle.
    """
    keys = as_list(keys)
    repeated = written(duplicate_keys(df, keys).select(*keys), "repeated-keys")
    return df.join(repeated, null_safe_on(df, repeated, keys), "left_semi")


def duplicate_classification(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Repeated keys with their rows, their distinct rows, and whether the rows agree.

    Only rows behind repeated keys are compared. Equal rows collapse first, on all columns, so
    neither a hot key nor a large group of copies reaches one task.
    """
    keys = as_list(keys)
    variants = duplicate_rows(df, keys).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    per_key = variants.groupBy(*keys).agg(
        F.sum("copies").cast("bigint").alias("occurrences"),
        F.count(F.lit(1)).alias("distinct_rows"),
    )
    kind = F.when(F.col("distinct_rows") == 1, "exact").otherwise("conflicting")
    return per_key.withColumn("duplicate_kind", kind)


class ConflictingDuplicates(ValueError):
    """Rows share a key but differ; keeping one of them would be a guess."""


def require_consistent(df: DataFrame, keys: str | Sequence[str], null_keys: str = "keep") -> None:
    """Raise if rows that share a key differ, comparing every column by value. Runs a job.

    Minimum, maximum and populated rows of each column are folded before the shuffle. With
    ``null_keys="conflict"`` a NULL key counts as a key; otherwise rows without one are not checked.
    """
    keys = as_list(keys)
    if null_keys != "conflict":
        df = df.dropna(subset=keys)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    parts = [F.to_json(c) if "map<" in kinds[c] else F.col(c) for c in df.columns if c not in keys]
    aggregates = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(parts):
        aggregates += [F.min(c).alias(f"_lo{i}"), F.max(c).alias(f"_hi{i}"), F.count(c).alias(f"_n{i}")]
    differs = reduce(lambda a, b: a | b, [
        (F.col(f"_lo{i}") != F.col(f"_hi{i}")) | ((F.col(f"_n{i}") > 0) & (F.col(f"_n{i}") < F.col("_n")))
        for i in range(len(parts))], F.lit(False))
    conflict = df.groupBy(*keys).agg(*aggregates).filter(differs).select(*keys).take(1)
    if conflict:
        raise ConflictingDuplicates(f"differing rows for {conflict[0].asDict()}")


def row_digest(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns: equal rows have equal ones, differing rows nearly always differ."""
    return [F.xxhash64(F.lit(salt), *df.columns) for salt in (1, 2)]


def dedup_exact(
    df: DataFrame, keys: str | Sequence[str] | None = None, on_conflict: str = "error",
    null_keys: str = "keep", long_text: bool = False,
) -> DataFrame:
    """Keep one of each set of equal rows; rows are dropped on full equality, never on a hash.

    With ``keys`` the result must be unique on them: ``on_conflict="error"`` checks at once and raises,
    ``"keep"`` leaves all differing rows in place for review. Rows without a key stay
    (``null_keys="keep"``), go (``"drop"``) or are held to the rule like any key (``"conflict"``).

    Narrow rows are folded on the map side and shuffled whole. With ``long_text`` they are not: only keys
    and 16-byte digests are shuffled, which tell the digests that repeat and the keys with rows of
    several digests. Rows whose digest is alone pass as they are; the others, whole, are compared with each
    other, so that neither a row nor a conflict hides behind a digest that two different rows share.
    That path reads the table three times and runs jobs at once; without repeated rows the table comes back untouched.
    """
    if on_conflict not in ("error", "keep"):
        raise ValueError("on_conflict is 'error' or 'keep'")
    if null_keys not in ("keep", "drop", "conflict"):
        raise ValueError("null_keys is 'keep', 'drop' or 'conflict'")
    keys = as_list(keys) if keys is not None else []
    if keys and null_keys == "drop":
        df = df.dropna(subset=keys)
    checked = bool(keys) and on_conflict == "error"
    if long_text:
        return _dedup_by_digest(df, keys, checked, null_keys)
    if checked:
        require_consistent(df, keys, null_keys)
    return df.distinct()


def _dedup_by_digest(df: DataFrame, keys: list[str], checked: bool, null_keys: str) -> DataFrame:
    marks = ["_digest0", "_digest1"]
    hashed = df.withColumns(dict(zip(marks, row_digest(df))))

    def conflicts(rows: DataFrame) -> DataFrame:
        """Keys with several of ``rows``; those without a key only if they count as one."""
        rows = rows if null_keys == "conflict" else rows.dropna(subset=keys)
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_variants")).filter("_variants > 1").select(*keys)

    def refuse(found: DataFrame) -> None:
        if conflict := found.take(1):
            raise ConflictingDuplicates(f"differing rows for {conflict[0].asDict()}")

    groups = hashed.groupBy(*(keys if checked else []), *marks).agg(F.count(F.lit(1)).alias("_n"))
    if checked:
        groups = written(groups, "row-digests")
        refuse(conflicts(groups))
    repeated = written(groups.filter("_n > 1").select(*marks).distinct(), "repeated-digests")
    if repeated.isEmpty():
        return df
    listed = repeated.toDF("_listed0", "_listed1")
    same = all_of(hashed[m] == listed[n] for m, n in zip(marks, listed.columns))
    kept = written(hashed.join(listed, same, "left_semi").drop(*marks).distinct(), "repeated-rows")
    if checked:
        refuse(conflicts(kept))
    return hashed.join(listed, same, "left_anti").drop(*marks).unionByName(kept)


def business_grain_check(df: DataFrame, grain: Sequence[str], row_id: str) -> DataFrame:
    """Groups of the business grain that hold more than one distinct row id."""
    ids = df.groupBy(*grain, row_id).agg(F.count(F.lit(1)).alias("copies"))
    groups = ids.groupBy(*grain).agg(
        F.count(row_id).alias("distinct_ids"),
        F.sum("copies").cast("bigint").alias("row_count"),
    )
    return groups.filter(F.col("distinct_ids") > 1)
