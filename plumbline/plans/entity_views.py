"""The contractor exports in their own shape, derived from the test tables at any scale.

``P`` projects, ``B`` budgets and ``T`` transactions come from orders, ``H`` labor hours and ``A``
progress updates from events. All rows of the source table take part; keys stay unique but for
the planted exact duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import folded, mapped
from plumbline.plans import views
from plumbline.plans.entity_cleaning import labor_cost
from plumbline.plans.tables import table
from plumbline.plans.views import orders_view, updates_view

# Raw labels planted in the views.
CATEGORY_LABELS = [
    "General conditions", "labor", "materials ", "Sub-Contractor", "Sub-Contractors",
    "Subcontractors", "Materials", "Permits ",
]
TRADE_LABELS = ["Carpenter", "Laborer", "Finisher", "Superintendent", "carpenter ", "General Labor"]
CHANGE_STATUSES = ["approved", "pending", "Approved", "PENDING ", "rejected"]
DELAY_REASONS = ["weather", "Weather ", "permit delay", "none", "material shortage"]
SUBMITTERS = ["superintendent", "project manager", "Project Manager"]
PAID_AS = {"f": "paid", "o": "approved", "p": "pending"}

_CATEGORY_LIST = ", ".join(f"'{c}'" for c in CATEGORY_LABELS)
_CHANGE_LIST = ", ".join(f"'{c}'" for c in CHANGE_STATUSES)
_REASON_LIST = ", ".join(f"'{r}'" for r in DELAY_REASONS)
_SUBMITTER_LIST = ", ".join(f"'{n}'" for n in SUBMITTERS)
_TRADE_LIST = ", ".join(f"'{t}'" for t in TRADE_LABELS)

ENTITY_SQL = {
    "P": """
P AS (SELECT 'P' || o_orderkey AS project_id,
  CASE WHEN o_orderkey % 509 = 0 THEN 'paused'
       WHEN LOWER(TRIM(status_raw)) = 'f' THEN
         CASE WHEN o_orderkey % 10 = 0 THEN 'Complete' ELSE 'completed' END
       WHEN LOWER(TRIM(status_raw)) = 'o' THEN
         CASE WHEN o_orderkey % 10 = 1 THEN ' active ' ELSE 'active' END
       ELSE CASE WHEN o_orderkey % 10 = 2 THEN 'On Hold' ELSE 'on_hold' END END AS project_status,
  CASE WHEN o_orderkey % 401 = 0 THEN NULL ELSE 'type ' || o_orderkey % 5 END AS project_type,
  date_text AS baseline_completion_date, price_text AS original_contract_value,
  o_orderkey % 100000 AS original_budget FROM O)""",
    "B": f"""
B AS (SELECT 'BUD-' || o_orderkey AS budget_line_id, 'P' || o_orderkey % 97 AS project_id,
  [{_CATEGORY_LIST}][o_orderkey % 8 + 1] AS cost_category,
  CASE WHEN o_orderkey % 499 = 0 THEN NULL ELSE o_orderkey % 70000 END AS original_budget_amount,
  CASE WHEN o_orderkey % 131 = 0
       THEN '$' || format('{{:,.2f}}', CAST(o_orderkey % 5000 AS DOUBLE))
       ELSE o_orderkey % 5000 || '.49' END AS approved_budget_change,
  CAST(o_orderkey % 70000 + o_orderkey % 5000 AS DOUBLE) AS revised_budget_amount FROM O)""",
    "T": f"""
T AS (SELECT format('TX{{:06d}}', o_orderkey) AS transaction_id, 'P' || o_custkey AS project_id,
  [{_CATEGORY_LIST}][o_orderkey % 8 + 1] AS cost_category,
  CASE WHEN o_orderkey % 503 = 0 THEN '-1800.00' ELSE price_text END AS amount,
  CASE WHEN o_orderkey % 211 = 0 THEN upper(s) || ' ' ELSE s END AS payment_status
  FROM (SELECT *, CASE LOWER(TRIM(status_raw)) WHEN 'f' THEN 'paid' WHEN 'o' THEN 'approved'
        WHEN 'p' THEN 'pending' ELSE 'applied' END AS s FROM O))""",
    "H": f"""
H_base AS (SELECT format('TE{{:06d}}', event_id) AS time_entry_id, 'P' || event_id % 97 AS project_id,
  'E' || user_id AS employee_id, [{_TRADE_LIST}][event_id % 6 + 1] AS trade,
  CASE WHEN event_id % 1009 = 0 THEN 'unknown'
       WHEN event_id % 173 = 0 THEN strftime(ts, '%-m/%-d/%Y')
       ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS work_date,
  CAST(CAST(event_id % 4000 AS DECIMAL(10,4)) * CAST(0.0113 AS DECIMAL(5,4)) AS DECIMAL(10,4))
    AS regular_hours,
  CAST(event_id % 4 AS DECIMAL(10,2)) AS overtime_hours,
  CAST(27 + event_id % 41 AS DECIMAL(10,2)) AS rate, event_id FROM events),
H AS (SELECT time_entry_id, project_id, employee_id, trade, work_date, regular_hours,
  overtime_hours, CASE WHEN event_id % 499 = 0 THEN NULL ELSE rate END AS hourly_rate,
  CAST(CAST(round(regular_hours * rate + overtime_hours * rate * CAST(1.5 AS DECIMAL(2,1)), 2)
         AS DECIMAL(10,2))
    + CAST(CASE WHEN event_id % 997 = 0 THEN 125.00 WHEN event_id % 53 = 0 THEN -0.01 ELSE 0.00 END
         AS DECIMAL(5,2)) AS DECIMAL(10,2)) AS labor_cost FROM H_base)""",
    "A": """
A AS (SELECT format('UPD{:05d}', event_id) AS update_id, 'P' || user_id AS project_id,
  CASE WHEN event_id % 173 = 0 THEN strftime(ts, '%-m/%-d/%Y')
       ELSE CAST(report_date AS VARCHAR) END AS report_date,
  pct_text AS actual_pct_complete, planned_pct AS planned_pct_complete,
  CASE WHEN event_id % 499 = 0 THEN NULL
       ELSE CAST(report_date + CAST(event_id % 40 - 10 AS INTEGER) AS TIMESTAMP) END
    AS forecast_completion_date FROM U)""",
    "C": f"""
C AS (SELECT format('CO{{:06d}}', o_orderkey - o_orderkey % 2 * (o_orderkey % 7 // 6)) AS change_order_id,
  'P' || o_custkey AS project_id, CASE WHEN o_orderkey % 12 = 0 THEN 'deductive' ELSE 'additive' END AS change_order_type,
  [{_CHANGE_LIST}][o_orderkey % 5 + 1] AS status, price_text AS approved_revenue_change,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE date_text END AS approval_date FROM O)""",
    "D": f"""
D AS (SELECT format('UPD{{:05d}}', event_id) AS update_id, 'P' || user_id AS project_id, actual_pct,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE [{_REASON_LIST}][event_id % 5 + 1] END AS primary_delay_reason,
  [{_SUBMITTER_LIST}][event_id % 3 + 1] AS submitted_by,
  CASE WHEN event_id % 401 = 0 THEN NULL ELSE CAST((100 - COALESCE(actual_pct, 0)) * (event_id % 977)
    AS DECIMAL(18,4)) END AS estimated_cost_to_complete FROM U)""",
}
views.SQL.update(ENTITY_SQL)


def _label(labels: list[str], number: Column) -> Column:
    place = (number % len(labels)).cast("int")
    return F.get(F.array(*[F.lit(label) for label in labels]), place)


def _numbered(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status = F.col("o_orderkey"), folded(F.col("status_raw"))
    return orders_view(spark, sf_dir).select(
        _numbered("P", key).alias("project_id"),
        F.when(key % 509 == 0, "paused")
        .when(status == "f", F.when(key % 10 == 0, "Complete").otherwise("completed"))
        .when(status == "o", F.when(key % 10 == 1, " active ").otherwise("active"))
        .otherwise(F.when(key % 10 == 2, "On Hold").otherwise("on_hold")).alias("project_status"),
        F.when(key % 401 != 0, _numbered("type ", key % 5)).alias("project_type"),
        F.col("date_text").alias("baseline_completion_date"),
        F.col("price_text").alias("original_contract_value"),
        (key % 100000).alias("original_budget"),
    )


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    change = key % 5000
    return orders_view(spark, sf_dir).select(
        _numbered("BUD-", key).alias("budget_line_id"),
        _numbered("P", key % 97).alias("project_id"),
        _label(CATEGORY_LABELS, key).alias("cost_category"),
        F.when(key % 499 != 0, key % 70000).alias("original_budget_amount"),
        F.when(key % 131 == 0, F.concat(F.lit("$"), F.format_number(change.cast("double"), 2)))
        .otherwise(F.concat(change.cast("string"), F.lit(".49"))).alias("approved_budget_change"),
        (key % 70000 + change).cast("double").alias("revised_budget_amount"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = mapped(folded(F.col("status_raw")), PAID_AS, F.lit("applied"))
    return orders_view(spark, sf_dir).select(
        F.format_string("TX%06d", key).alias("transaction_id"),
        _numbered("P", F.col("o_custkey")).alias("project_id"),
        _label(CATEGORY_LABELS, key).alias("cost_category"),
        F.when(key % 503 == 0, "-1800.00").otherwise(F.col("price_text")).alias("amount"),
        F.when(key % 211 == 0, F.concat(F.upper(status), F.lit(" "))).otherwise(status)
        .alias("payment_status"),
    )


def labor(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, ts = F.col("event_id"), F.col("ts")
    step = F.lit(0.0113).cast("decimal(5,4)")
    hours = ((key % 4000).cast("decimal(10,4)") * step).cast("decimal(10,4)")
    overtime = (key % 4).cast("decimal(10,2)")
    rate = (key % 41 + 27).cast("decimal(10,2)")
    deviation = F.when(key % 997 == 0, 125.00).when(key % 53 == 0, -0.01).otherwise(0.00)
    paid = labor_cost(hours, overtime, rate).cast("decimal(10,2)")
    return table(spark, sf_dir, "events").select(
        F.format_string("TE%06d", key).alias("time_entry_id"),
        _numbered("P", key % 97).alias("project_id"),
        _numbered("E", F.col("user_id")).alias("employee_id"),
        _label(TRADE_LABELS, key).alias("trade"),
        F.when(key % 1009 == 0, "unknown")
        .when(key % 173 == 0, F.date_format(ts, "M/d/yyyy"))
        .otherwise(ts.cast("date").cast("string")).alias("work_date"),
        hours.alias("regular_hours"),
        overtime.alias("overtime_hours"),
        F.when(key % 499 != 0, rate).alias("hourly_rate"),
        (paid + deviation.cast("decimal(5,2)")).cast("decimal(10,2)").alias("labor_cost"),
    )


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, report = F.col("event_id"), F.col("report_date")
    forecast = F.date_add(report, (key % 40 - 10).cast("int")).cast("timestamp_ntz")
    return updates_view(spark, sf_dir).select(
        F.format_string("UPD%05d", key).alias("update_id"),
        _numbered("P", F.col("user_id")).alias("project_id"),
        F.when(key % 173 == 0, F.date_format("ts", "M/d/yyyy")).otherwise(report.cast("string"))
        .alias("report_date"),
        F.col("pct_text").alias("actual_pct_complete"),
        F.col("planned_pct").alias("planned_pct_complete"),
        F.when(key % 499 != 0, forecast).alias("forecast_completion_date"),
    )


def change_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change orders: some ids occur twice, statuses vary in writing, approvals are partly open."""
    key = F.col("o_orderkey")
    return orders_view(spark, sf_dir).select(
        F.format_string("CO%06d", key - key % 2 * F.floor(key % 7 / 6)).alias("change_order_id"),
        _numbered("P", F.col("o_custkey")).alias("project_id"),
        F.when(key % 12 == 0, "deductive").otherwise("additive").alias("change_order_type"),
        _label(CHANGE_STATUSES, key).alias("status"),
        F.col("price_text").alias("approved_revenue_change"),
        F.when(key % 3 != 0, F.col("date_text")).alias("approval_date"),
    )


def update_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the updates that say why, by whom and how much is still to be spent."""
    key = F.col("event_id")
    left = (F.lit(100) - F.coalesce("actual_pct", F.lit(0))) * (key % 977)
    return updates_view(spark, sf_dir).select(
        F.format_string("UPD%05d", key).alias("update_id"),
        _numbered("P", F.col("user_id")).alias("project_id"), "actual_pct",
        F.when(key % 6 != 0, _label(DELAY_REASONS, key)).alias("primary_delay_reason"),
        _label(SUBMITTERS, key).alias("submitted_by"),
        F.when(key % 401 != 0, left.cast("decimal(18,4)")).alias("estimated_cost_to_complete"),
    )
