"""Business rules: compare recorded values with what other columns imply.

Money is decimal before any arithmetic; a row with a missing part is untestable, not wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# In the order of 2 * (first matches) + (second matches).
OUTCOMES = ("neither", "second_only", "first_only", "both")


def order_violations(df: DataFrame, first: Column, second: Column, strict: bool = False):
    """Rows where ``first`` should not exceed ``second`` but does (or equals it, if strict)."""
    return df.filter(first >= second if strict else first > second)


def sum_rule_mismatches(df: DataFrame, parts: Sequence[str], total: str) -> DataFrame:
    """Rows whose parts do not add up to the total, with the variance.

    A missing part or total makes the variance NULL, so untestable rows do not show.
    """
    calculated = reduce(lambda a, b: a + b, [F.col(c) for c in parts])
    return (
        df.withColumn("calculated_total", calculated)
        .withColumn("variance", F.col(total) - F.col("calculated_total"))
        .filter(F.col("variance") != 0)
    )


def rule_reconciliation(df: DataFrame, expected: Column, actual: Column) -> DataFrame:
    """Matching, mismatching and untestable rows, and whether they add up to all rows."""
    matches = F.col("matches")
    counts = df.select((expected == actual).alias("matches")).agg(
        F.count_if(matches).alias("matching"),
        F.count_if(~matches).alias("mismatching"),
        F.count_if(matches.isNull()).alias("untestable"),
        F.count(F.lit(1)).alias("total_rows"),
    )
    classified = F.col("matching") + F.col("mismatching") + F.col("untestable")
    return counts.withColumn("classified", classified).withColumn(
        "reconciles", F.col("classified") == F.col("total_rows")
    )


def mismatch_histogram(df: DataFrame, expected: Column, actual: Column) -> DataFrame:
    """How many rows differ by how much."""
    return (
        df.filter(expected != actual)
        .groupBy((actual - expected).alias("difference"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.desc("row_count"), "difference")
    )


def mismatch_rows(df: DataFrame, expected: Column, actual: Column, delta) -> DataFrame:
    """Rows that differ by one given amount, with the expected value."""
    return df.withColumn("expected", expected).filter(actual - F.col("expected") == F.lit(delta))


def formula_outcome(first: Column, second: Column, actual: Column) -> Column:
    """Which of two formulas reproduces the recorded value; NULL where one cannot be tested.

    Each formula occurs once in the expression: decimal arithmetic is the costly part.
    """
    place = (first == actual).cast("int") * 2 + (second == actual).cast("int")
    return F.get(F.array(*[F.lit(name) for name in OUTCOMES]), place)


def formula_overlap(df: DataFrame, first: Column, second: Column, actual: Column) -> DataFrame:
    outcome = F.col("outcome")
    return df.select(formula_outcome(first, second, actual).alias("outcome")).agg(
        F.count(outcome).alias("testable"),
        *[F.count_if(outcome == name).alias(name) for name in OUTCOMES],
    )


def formula_outcome_rows(
    df: DataFrame, first: Column, second: Column, actual: Column, outcomes: Sequence[str]
) -> DataFrame:
    """Rows with the chosen outcomes and both differences."""
    rows = df.withColumns({
        "first_difference": actual - first,
        "second_difference": actual - second,
        "outcome": formula_outcome(first, second, actual),
    })
    return rows.filter(F.col("outcome").isin(*outcomes))


def derive_missing(
    df: DataFrame, column: str, candidate: Column, check: Callable[[Column], Column]
) -> DataFrame:
    """Candidate for a missing value from a proven rule.

    The raw column stays. ``<column>_candidate`` is set only where the value is missing,
    ``<column>_inferred`` marks it, and ``<column>_confirmed`` tells whether putting the
    candidate back into the rule reproduces the record.
    """
    missing = F.col(column).isNull()
    name = f"{column}_candidate"
    rows = df.withColumn(name, F.when(missing, candidate))
    return rows.withColumns({
        f"{column}_inferred": F.col(name).isNotNull(),
        f"{column}_confirmed": F.when(F.col(name).isNotNull(), check(F.col(name))),
    })


def candidate_search(
    df: DataFrame,
    start: int,
    stop: int,
    scale: int,
    formula: Callable[[Column], Column],
    target: Column,
    monotone: bool = False,
) -> DataFrame:
    """Try every value of a grid on each row and keep those that reproduce the target exactly.

    The grid runs from ``start`` to ``stop`` (inclusive) in steps of ``10**-scale``, given in
    those steps; ``matching_candidates`` is 1 where the solution is unique. Only matches leave the
    task, so the grid may have any length.

    Each row is dealt one grid value after the other. With ``monotone`` the caller states that the
    formula never turns round as the candidate grows (it may rise or fall, row by row, and stay
    level for a while, as rounded formulas do). The matches then lie together, and both ends are
    found by halving the grid: some 2 log2(grid) trials a row instead of one for each grid value.
    """
    size = stop - start + 1
    if size < 1:
        raise ValueError("the grid is empty")
    kind = f"decimal({len(str(max(abs(start), abs(stop)))) + scale + 1},{scale})"
    step = F.lit(1).cast(f"decimal({scale + 1},{scale})") / (10**scale)
    step = step.cast(f"decimal({scale + 1},{scale})")

    def value(i: Column) -> Column:
        return (i.cast("decimal(18,0)") * step).cast(kind)

    tried = F.lit(size).cast("bigint").alias("candidates_tried")
    if monotone:
        ends = df.withColumns({"_first": formula(value(F.lit(start))), "_last": formula(value(F.lit(stop))), "_target": target})
        rising = F.col("_last") >= F.col("_first")

        def short_of(beyond: bool) -> Column:
            """Grid values before the formula reaches the target, or goes beyond it."""
            def open_at(c: Column) -> Column:
                got, goal = formula(c), F.col("_target")
                return F.when(rising, got <= goal if beyond else got < goal).otherwise(got >= goal if beyond else got > goal)

            halves = F.array(*[F.lit(1 << b) for b in reversed(range(size.bit_length()))])
            return F.aggregate(halves, F.lit(0), lambda at, half: F.when(
                (at + half <= size) & open_at(value(F.least(at + half, F.lit(size)) + (start - 1))), at + half).otherwise(at))

        found = ends.withColumns({"_from": short_of(False), "_to": short_of(True)}).filter("_from < _to")
        found = found.withColumn("_i", F.explode(F.sequence(F.col("_from") + start, F.col("_to") + (start - 1))))
        return found.select(*df.columns, tried, (F.col("_to") - F.col("_from")).cast("bigint").alias("matching_candidates"),
                            value(F.col("_i")).alias("candidate"))

    # The target is worked out once per row, and rows with the same number keep one identity.
    numbered = df.withColumns({"_target": target, "_row": F.monotonically_increasing_id()})
    dealt = numbered.withColumn("_i", F.explode(F.sequence(F.lit(start), F.lit(stop))))
    matches = dealt.withColumn("candidate", value(F.col("_i"))).filter(formula(F.col("candidate")) == F.col("_target"))
    per_row = Window.partitionBy("_row")
    return matches.withColumn("matching_candidates", F.count(F.lit(1)).over(per_row)).select(
        *df.columns, tried, "matching_candidates", "candidate")


def attribute_history(df: DataFrame, entity: str, attribute: str, date: str) -> DataFrame:
    """When each attribute value of an entity was first and last seen, and how often."""
    return df.groupBy(entity, attribute).agg(
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.count(F.lit(1)).alias("row_count"),
    )
