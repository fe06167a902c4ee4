"""Checks whose finding the plain tables do not have, on views in which it is planted at every scale.

Unknown projects of budgets and updates, labels of missing documents, turns numbered twice, planned
progress that falls, and histories of which only some are affected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import keys, referential, sequence
from plumbline.plans import entity_views
from plumbline.plans.registry import query
from plumbline.plans.tables import table
from plumbline.plans.views import updates_view

# Each planted: a value for Spark, and the same for DuckDB.
ORPHAN_EVERY, UNKNOWN_EVERY, FALL_EVERY, RARE_FALL_EVERY = 61, 83, 211, 1499


def _number_of(identifier: str, prefix: int) -> Column:
    return F.substring(identifier, prefix + 1, 20).cast("bigint")


def _planted_project(number: Column) -> Column:
    return F.when(number % ORPHAN_EVERY == 0, F.concat(F.lit("P9"), F.lit("0" * 8), (number % 3).cast("string"))).when(
        number % UNKNOWN_EVERY != 0, F.col("project_id"))


def _orphans_sql(source: str, number: str) -> str:
    return f"""SELECT x.project_id, COUNT(*) AS row_count FROM (SELECT * REPLACE (CASE
    WHEN {number} % {ORPHAN_EVERY} = 0 THEN 'P9' || '{"0" * 8}' || {number} % 3
    WHEN {number} % {UNKNOWN_EVERY} <> 0 THEN project_id END AS project_id) FROM {source}) x
  LEFT JOIN (SELECT DISTINCT project_id FROM P) p ON x.project_id = p.project_id
  WHERE p.project_id IS NULL GROUP BY 1"""


@query(_orphans_sql("B", "CAST(substr(budget_line_id, 5) AS BIGINT)"), "OPB")
def orphan_counts_planted_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of projects that do not exist, and budgets without a project."""
    budgets = entity_views.budgets(spark, sf_dir)
    planted = budgets.withColumn("project_id", _planted_project(_number_of("budget_line_id", 4)))
    return referential.orphan_counts(planted, entity_views.projects(spark, sf_dir), "project_id")


@query(_orphans_sql("D", "CAST(substr(update_id, 4) AS BIGINT)"), "OUPD")
def orphan_counts_planted_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = entity_views.update_details(spark, sf_dir)
    planted = updates.withColumn("project_id", _planted_project(_number_of("update_id", 3)))
    return referential.orphan_counts(planted, entity_views.projects(spark, sf_dir), "project_id")


@query("""SELECT x.doc_id, COUNT(*) AS row_count FROM (SELECT CASE WHEN doc_id % 7 = 3 THEN doc_id + 1000000000000 ELSE doc_id END AS doc_id
  FROM labels) x LEFT JOIN documents ON x.doc_id = documents.doc_id WHERE documents.doc_id IS NULL GROUP BY 1""")
def orphan_counts_planted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents that are gone."""
    doc = F.col("doc_id")
    labels = table(spark, sf_dir, "labels").select(F.when(doc % 7 == 3, doc + 1_000_000_000_000).otherwise(doc).alias("doc_id"))
    return referential.orphan_counts(labels, table(spark, sf_dir, "documents"), "doc_id")


TURNS_SQL = """(SELECT conv_id, CASE WHEN conv_id % 5 = 2 AND turn = 2 THEN 1 ELSE turn END AS turn, role,
  CASE WHEN conv_id % 10 = 2 AND turn = 2 THEN 'again' ELSE text END AS text FROM conversations)"""


def _repeated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", F.when((conv % 5 == 2) & (turn == 2), 1).otherwise(turn).alias("turn"), "role",
        F.when((conv % 10 == 2) & (turn == 2), "again").otherwise(F.col("text")).alias("text"))


@query(f"""SELECT conv_id, turn, COUNT(*) AS occurrences FROM {TURNS_SQL}
  GROUP BY conv_id, turn HAVING COUNT(*) > 1""")
def duplicate_keys_planted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that carry the number of the turn before."""
    return keys.duplicate_keys(_repeated_turns(spark, sf_dir), ["conv_id", "turn"])


@query(f"""SELECT conv_id, turn, COUNT(*) AS occurrences, COUNT(DISTINCT (role, text)) AS distinct_rows,
  CASE WHEN COUNT(DISTINCT (role, text)) = 1 THEN 'exact' ELSE 'conflicting' END AS duplicate_kind
  FROM {TURNS_SQL} GROUP BY conv_id, turn HAVING COUNT(*) > 1""")
def duplicate_classification_planted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.duplicate_classification(_repeated_turns(spark, sf_dir), ["conv_id", "turn"])


def _plan_sql(every: int) -> str:
    return f"""(SELECT * REPLACE (CAST(CASE WHEN event_id % {every} = 0 THEN planned_pct - 10 ELSE planned_pct END
    AS DECIMAL(6,1)) AS planned_pct), LAG(CAST(CASE WHEN event_id % {every} = 0 THEN planned_pct - 10 ELSE planned_pct END
    AS DECIMAL(6,1))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_value FROM U)"""


def _falling_plan(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    """Planned progress that is taken back by ten points now and then."""
    planned = F.col("planned_pct")
    lowered = F.when(F.col("event_id") % every == 0, planned - 10).otherwise(planned)
    return updates_view(spark, sf_dir, written=True).withColumn("planned_pct", lowered.cast("decimal(6,1)"))


@query(f"""SELECT event_id, user_id, ts, planned_pct, previous_value, CAST(previous_value - planned_pct AS DECIMAL(7,1)) AS decrease
  FROM {_plan_sql(FALL_EVERY)} WHERE planned_pct < previous_value""", "U")
def monotonic_violations_planted_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _falling_plan(spark, sf_dir, FALL_EVERY).select("event_id", "user_id", "ts", "planned_pct")
    return sequence.monotonic_violations(rows, "user_id", ["ts", "event_id"], "planned_pct")


@query(f"""SELECT * EXCLUDE (previous_value) FROM {_plan_sql(RARE_FALL_EVERY)} WHERE user_id IN (
  SELECT user_id FROM {_plan_sql(RARE_FALL_EVERY)} WHERE planned_pct < previous_value)""", "U")
def affected_histories_planted_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole histories of the few users whose plan was taken back."""
    return sequence.affected_histories(
        _falling_plan(spark, sf_dir, RARE_FALL_EVERY), "user_id", ["ts", "event_id"], "planned_pct")
