"""Order-dependent values without sorting a table, or one large entity, in a single task.

An entity that fits one task is windowed as usual. A whole table, or an entity with more than
its share of the rows, is cut by its order keys into ranges of about equal row counts, and
the window runs inside (entity, range). What crosses a range border travels in one extra row per
range: the neighbouring range's edge value, or the number of rows that come before. A range
holds about rows / ranges rows, whatever share of the table an entity holds. The cuts are whole
keys (all order keys, NULL last, then a hash of the row), so neither a value that fills several
ranges, nor text with a long common beginning, nor rows without any order key stay together.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.shaping import all_of
from plumbline.sources.tables import written

ROWS_PER_RANGE = 4_000_000
MAX_RANGES = 50_000
# Several ranges per shuffle partition even out what hashing their numbers puts together, but
# what one task sorts in a second is not worth cutting; the rows come out the same either way.
RANGES_PER_TASK = 4
MIN_ROWS_PER_RANGE = 250_000
SAMPLED_ROWS_PER_RANGE = 60
_EDGE = "_edge"
_HOT = "_hot"
_RANGE = "_range"
_TIE = "_tie"
_CUTS = "_cuts"


def _cut_key(order: Sequence[str]) -> Column:
    """Order keys and the tie-break as one value of their own types, NULL after everything else."""
    parts = [part for k in order for part in (F.col(k).isNull(), F.col(k))]
    return F.struct(*[part.alias(f"k{i}") for i, part in enumerate(parts)], F.col(_TIE).alias("tie"))


def _with_tie(df: DataFrame) -> DataFrame:
    """Rows with equal order keys are told apart by a hash of their columns."""
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return df.withColumn(_TIE, F.xxhash64(*hashed))


def _cut_points(sample: DataFrame, by: Sequence[str], per_range: float) -> DataFrame:
    """``by, _cuts``: sorted cut keys of each group that fills more than one range.

    A group gets one cut per full share of sampled rows, so all groups together get at most
    as many cuts as there are ranges. Without ``by`` the sample, whose size is set by the number
    of ranges, is one group.
    """
    ranked = Window.partitionBy(*(by or [F.lit(0)])).orderBy("key")
    number = F.floor((F.row_number().over(ranked) - 1) / F.lit(max(1.0, per_range)))
    heads = sample.withColumn("range", number).filter("range > 0").groupBy(*by, "range").agg(
        F.min("key").alias("cut"))
    return heads.groupBy(*by).agg(F.sort_array(F.collect_list("cut")).alias(_CUTS))


def _number(cuts: Column, key: Column, most: int) -> Column:
    """Cuts that are not above the key, by binary search."""
    steps = [1 << i for i in reversed(range(max(1, most).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when(F.get(cuts, at + step - 1) <= key, at + step).otherwise(at),
    )


def with_ranges(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), ranges: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Add a range number that follows the order keys; NULL keys come last.

    With ``by`` only groups too large for one task are cut, all others stay in range 0; without
    any such group no column is added. Rows that were cut carry ``_hot``; ``_tie`` is the last
    order key of all rows.

    Cut points and large groups come from a small sample and only steer the balance: any choice
    gives the same results, and no row is left out. Cuts keep the types of the keys, so whatever
    Spark can order can be cut. Runs a count, the projection and a job on the sample at once.
    """
    ranged, _, numbers = _ranged(df, list(order), list(by), [], ranges)
    return ranged, numbers


def _ranged(
    df: DataFrame, order: list[str], by: list[str], sources: list[str], ranges: int | None
) -> tuple[DataFrame, DataFrame, list[str]]:
    """``with_ranges``, and besides its rows those of a written projection (``by``, keys, ``sources``)."""
    n = df.agg(F.count(F.lit(1))).first()[0]
    if ranges is None:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        by_tasks = min(RANGES_PER_TASK * tasks, math.ceil(n / MIN_ROWS_PER_RANGE))
        ranges = min(MAX_RANGES, max(math.ceil(n / ROWS_PER_RANGE), by_tasks))
    if ranges < 2 or not n:
        return df, df, []

    tied = _with_tie(df)
    narrow = written(tied.select(*dict.fromkeys([*by, *order, *sources, _TIE])), "order-keys")
    share = min(1.0, ranges * SAMPLED_ROWS_PER_RANGE / n)
    sample = narrow.select(*by, _cut_key(order).alias("key"))
    sample = sample.sample(fraction=share, seed=11) if share < 1 else sample
    # At most MAX_RANGES keys in all; written, so that every use finds the same cuts, in their own types.
    listed = written(_cut_points(sample, by, share * n / ranges), "cuts")
    if listed.isEmpty():
        return df, df, []
    if not by:
        def numbered(rows: DataFrame) -> DataFrame:
            cuts = listed.select(_CUTS).scalar()
            return rows.withColumn(_CUTS, cuts).withColumns(
                {_RANGE: _number(F.col(_CUTS), _cut_key(order), ranges), _HOT: F.lit(True)}).drop(_CUTS)

        return numbered(tied), numbered(narrow), [_RANGE]

    # At most one group per range: the list is written, so its size is known, and small.
    names = [f"_by{i}" for i in range(len(by))]
    listed = listed.toDF(*names, _CUTS)

    def marked(rows: DataFrame) -> DataFrame:
        same = all_of(F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by, names))
        found = rows.join(F.broadcast(listed), same, "left")
        number = F.coalesce(_number(F.col(_CUTS), _cut_key(order), ranges), F.lit(0))
        return found.withColumns({_RANGE: number, _HOT: F.col(_CUTS).isNotNull()}).drop(*names, _CUTS)

    return marked(tied), marked(narrow), [_RANGE]


def _nulls_last(order: Sequence[str]) -> list[Column]:
    return [F.asc_nulls_last(k) for k in order]


def _sort_key(order: Sequence[str]) -> Column:
    """Order keys and tie-break as one comparable value with NULL after everything else."""
    parts = [part for k in order for part in (F.col(k).isNull(), F.col(k))] + [F.col(_TIE)]
    return F.struct(*[part.alias(f"k{i}") for i, part in enumerate(parts)])


def with_neighbors(
    df: DataFrame,
    order: Sequence[str],
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    by: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Add values of the row before (``previous``) and after (``following``), per ``by`` group.

    Both map a new column to its source column. ``order`` must identify a row within its group,
    otherwise the neighbour is as arbitrary as in a plain window. Keys may be of any type that Spark
    orders. A table that is cut is read twice, once to write its keys and sources and once for the
    result, and counted: put costly derived input into a written table first. The count, the written
    projection and the sample run at once, before any action on the result.
    """
    previous, following = dict(previous or {}), dict(following or {})
    if not previous and not following:
        raise ValueError("name at least one neighbour")
    order, by = list(order), list(by)
    sources = sorted({*previous.values(), *following.values()})
    if set(sources) & set(by):
        raise ValueError("a grouping column is the same on every row of its group")

    def linked(rows: DataFrame, keys: list, first: Sequence[str] = ()) -> DataFrame:
        last = [_TIE] if first else []
        window = Window.partitionBy(*keys).orderBy(*first, *_nulls_last(order), *last)
        added = {name: F.lag(source).over(window) for name, source in previous.items()}
        added |= {name: F.lead(source).over(window) for name, source in following.items()}
        return rows.withColumns(added)

    ranged, narrow, numbers = _ranged(df, order, by, sources, ranges)
    if not numbers:
        return linked(df, by or [F.lit(0)])
    keys = [*by, *numbers]
    values, place = F.struct(*sources), _sort_key(order)
    # One row per non-empty (group, range): small, and at most MAX_RANGES rows for a group.
    along = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*numbers)
    ends, carried = [], []
    if previous:
        ends.append(F.max_by(values, place).alias("last"))
        carried.append(F.struct(F.lit(-1).alias(_EDGE), F.lag("last").over(along).alias("v")))
    if following:
        ends.append(F.min_by(values, place).alias("first"))
        carried.append(F.struct(F.lit(1).alias(_EDGE), F.lead("first").over(along).alias("v")))
    edges = narrow.filter(_HOT).groupBy(*keys).agg(*ends)
    edges = edges.select(*keys, F.array(*carried).alias("carried"))
    edges = edges.select(*keys, F.inline("carried")).filter(F.col("v").isNotNull())
    edges = edges.select(*keys, _EDGE, "v.*")

    rows = ranged.withColumn(_EDGE, F.lit(0)).unionByName(edges, allowMissingColumns=True)
    return linked(rows, keys, [_EDGE]).filter(F.col(_EDGE) == 0).drop(_EDGE, _HOT, _TIE, *numbers)


def with_row_numbers(
    df: DataFrame, order: Sequence[str], output: str, by: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Number the rows of each group in order, starting at 1."""
    order, by = list(order), list(by)
    ranged, narrow, numbers = _ranged(df, order, by, [], ranges)
    if not numbers:
        window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*_nulls_last(order))
        return df.withColumn(output, F.row_number().over(window).cast("bigint"))
    keys = [*by, *numbers]
    along = (
        Window.partitionBy(*(by or [F.lit(0)])).orderBy(*numbers)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = narrow.filter(_HOT).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # The extra row is numbered too, hence one less.
    before = F.coalesce(F.sum("n").over(along), F.lit(0)) - 1
    offsets = counts.select(*keys, F.lit(-1).alias(_EDGE), before.alias("_offset"))
    rows = ranged.withColumns({_EDGE: F.lit(0), "_offset": F.lit(None).cast("bigint")})
    rows = rows.unionByName(offsets, allowMissingColumns=True)
    window = Window.partitionBy(*keys).orderBy(_EDGE, *_nulls_last(order), _TIE)
    number = F.coalesce(F.first("_offset").over(window), F.lit(0)) + F.row_number().over(window)
    numbered = rows.withColumn(output, number).filter(F.col(_EDGE) == 0)
    return numbered.drop(_EDGE, _HOT, _TIE, "_offset", *numbers)
