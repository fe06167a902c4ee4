"""The remaining checks: change orders, references of budgets and updates, cost to complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.parsing import parse_ymd
from plumbline.operators import categorical, completeness, keys, numeric, parsing, referential
from plumbline.plans import entity_views
from plumbline.plans.profile_queries import KEY_PROFILE_SQL
from plumbline.plans.registry import query
from plumbline.plans.value_queries import _range_sql, _scale_sql

FREQUENCY_SQL = """SELECT {c} AS value, '[' || {c} || ']' AS display, COUNT(*) AS row_count
  FROM {t} GROUP BY {c}"""


@query(KEY_PROFILE_SQL.format(k="change_order_id", t="C",
                              blank="COUNT(*) FILTER (WHERE TRIM(change_order_id) = '')"), "OC")
def change_order_key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.key_profile(entity_views.change_orders(spark, sf_dir), "change_order_id")


CHANGE_COLUMNS = ["change_order_id", "project_id", "change_order_type", "status",
                  "approved_revenue_change", "approval_date"]


@query("\nUNION ALL ".join(f"""SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count,
  COUNT(*) AS total_rows FROM C""" for c in CHANGE_COLUMNS), "OC")
def change_order_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.null_profile(entity_views.change_orders(spark, sf_dir)).select(
        "column_name", "null_count", "total_rows")


@query(FREQUENCY_SQL.format(c="change_order_type", t="C"), "OC")
def change_order_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorical.value_frequency(entity_views.change_orders(spark, sf_dir), "change_order_type")


@query("""SELECT * FROM C WHERE status <> LOWER(TRIM(status))
  AND LOWER(TRIM(status)) IN ('approved', 'pending', 'rejected')""", "OC")
def change_order_status_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorical.variant_rows(entity_views.change_orders(spark, sf_dir), "status",
                                    ["approved", "pending", "rejected"])


@query("""SELECT * FROM C WHERE approval_date IS NOT NULL AND TRY_CAST(approval_date AS DATE) IS NULL""", "OC")
def change_order_date_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_failures(entity_views.change_orders(spark, sf_dir), "approval_date",
                                  parse_ymd(F.col("approval_date")), "parsed").select(*CHANGE_COLUMNS)


@query("""SELECT B.project_id, COUNT(*) AS row_count FROM B LEFT JOIN (SELECT DISTINCT project_id FROM P) p
  ON B.project_id = p.project_id WHERE p.project_id IS NULL GROUP BY 1""", "OPB")
def budget_project_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referential.orphan_counts(entity_views.budgets(spark, sf_dir), entity_views.projects(spark, sf_dir), "project_id")


@query("""SELECT D.project_id, COUNT(*) AS row_count FROM D LEFT JOIN (SELECT DISTINCT project_id FROM P) p
  ON D.project_id = p.project_id WHERE p.project_id IS NULL GROUP BY 1""", "OUPD")
def update_project_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referential.orphan_counts(
        entity_views.update_details(spark, sf_dir), entity_views.projects(spark, sf_dir), "project_id")


@query(_range_sql("D", ["estimated_cost_to_complete"], "0", "90000"), "UD")
def cost_to_complete_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.range_profile(entity_views.update_details(spark, sf_dir), ["estimated_cost_to_complete"], 0, 90000)


@query(_scale_sql("D", "estimated_cost_to_complete"), "UD")
def cost_to_complete_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.scale_loss_profile(entity_views.update_details(spark, sf_dir), "estimated_cost_to_complete")


@query("""SELECT *, finished + unfinished = over_threshold AS reconciles FROM (SELECT
  COUNT(*) FILTER (WHERE estimated_cost_to_complete > 0) AS over_threshold,
  COUNT(*) FILTER (WHERE estimated_cost_to_complete > 0 AND COALESCE(actual_pct, 0) >= 100) AS finished,
  COUNT(*) FILTER (WHERE estimated_cost_to_complete > 0 AND COALESCE(actual_pct, 0) < 100) AS unfinished FROM D)""", "UD")
def cost_to_complete_by_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money still to be spent on finished and unfinished work."""
    progress = F.coalesce("actual_pct", F.lit(0))
    return numeric.threshold_crosstab(
        entity_views.update_details(spark, sf_dir), F.col("estimated_cost_to_complete") > 0,
        {"finished": progress >= 100, "unfinished": progress < 100})


@query(FREQUENCY_SQL.format(c="primary_delay_reason", t="D"), "UD")
def delay_reason_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorical.value_frequency(entity_views.update_details(spark, sf_dir), "primary_delay_reason")


@query(FREQUENCY_SQL.format(c="submitted_by", t="D"), "UD")
def submitter_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorical.value_frequency(entity_views.update_details(spark, sf_dir), "submitted_by")
