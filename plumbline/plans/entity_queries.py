"""The five cleaned exports and the figures that need them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import dates, exposure, referential, rules
from plumbline.operators.cleaning import flag_counts
from plumbline.plans import entity_cleaning, entity_views
from plumbline.plans.cleaning_queries import flags_as_text, flags_sql, text_sql
from plumbline.plans.registry import query
from plumbline.sources.tables import publish_cleaned, shared_folder


def _money_sql(column: str, kind: str) -> str:
    return f"TRY_CAST(replace(replace({column}, '$', ''), ',', '') AS DECIMAL({kind}))"


def _map_sql(column: str, mapping: dict[str, str], default: str = "NULL") -> str:
    cases = " ".join(f"WHEN '{raw}' THEN '{std}'" for raw, std in mapping.items())
    return f"CASE LOWER(TRIM({column})) {cases} ELSE {default} END"


def _date_sql(column: str) -> str:
    return (f"COALESCE(TRY_CAST({column} AS DATE), "
            f"CAST(TRY_STRPTIME({column}, '%m/%d/%Y') AS DATE))")


STATUS_SQL = _map_sql("project_status", entity_cleaning.PROJECT_STATUSES)
CATEGORY_SQL = _map_sql("cost_category", entity_cleaning.COST_CATEGORIES, "TRIM(cost_category)")
TRADE_SQL = _map_sql("trade", entity_cleaning.TRADES, "TRIM(trade)")

PROJECTS_SQL = f"""SELECT *, {flags_sql({
    "status_standardized": "project_status <> std_project_status",
    "status_unknown": "std_project_status IS NULL",
    "type_unknown": "project_type IS NULL",
    "baseline_completion_unconfirmed":
        "baseline_completion_date IS NOT NULL AND std_baseline_completion_date IS NULL",
    "contract_value_reformatted": "std_original_contract_value IS NOT NULL AND "
        "TRY_CAST(original_contract_value AS DECIMAL(18,2)) IS NULL",
})} AS flags FROM (SELECT DISTINCT *, {STATUS_SQL} AS std_project_status,
  COALESCE(TRIM(project_type), 'unknown') AS std_project_type,
  TRY_CAST(baseline_completion_date AS DATE) AS std_baseline_completion_date,
  {_money_sql("original_contract_value", "18,2")} AS std_original_contract_value,
  CAST(original_budget AS DECIMAL(18,2)) AS std_original_budget FROM P)"""

BUDGETS_SQL = f"""SELECT *, {flags_sql({
    "category_standardized": "cost_category <> std_cost_category",
    "change_reformatted": "std_approved_budget_change IS NOT NULL AND "
        "TRY_CAST(approved_budget_change AS DECIMAL(10,2)) IS NULL",
    "original_budget_missing": "original_budget_amount IS NULL",
    "original_budget_inferred": "inferred_original_budget_amount IS NOT NULL",
})} AS flags FROM (SELECT *, CASE WHEN std_original_budget_amount IS NULL
    THEN CAST(std_revised_budget_amount - std_approved_budget_change AS DECIMAL(10,2)) END
    AS inferred_original_budget_amount
  FROM (SELECT DISTINCT *, {CATEGORY_SQL} AS std_cost_category,
  CAST(original_budget_amount AS DECIMAL(10,2)) AS std_original_budget_amount,
  {_money_sql("approved_budget_change", "10,2")} AS std_approved_budget_change,
  CAST(revised_budget_amount AS DECIMAL(10,2)) AS std_revised_budget_amount FROM B))"""

TRANSACTIONS_SQL = f"""SELECT *, {flags_sql({
    "project_corrected": "transaction_id IN ('TX000316', 'TX000729')",
    "project_missing": "std_project_id IS NULL",
    "category_standardized": "cost_category <> std_cost_category",
    "status_standardized": "payment_status <> std_payment_status",
    "status_unknown": "std_payment_status NOT IN ('paid', 'approved', 'pending', 'applied')",
    "amount_reformatted": "std_amount IS NOT NULL AND TRY_CAST(amount AS DECIMAL(10,2)) IS NULL",
    "amount_unparsed": "amount IS NOT NULL AND std_amount IS NULL",
    "credit": "std_amount < 0",
})} AS flags FROM (SELECT DISTINCT *, CASE transaction_id WHEN 'TX000316' THEN 'P003'
    WHEN 'TX000729' THEN 'P007' ELSE project_id END AS std_project_id,
  {CATEGORY_SQL} AS std_cost_category, LOWER(TRIM(payment_status)) AS std_payment_status,
  {_money_sql("amount", "10,2")} AS std_amount FROM T)"""

RATE_SQL = """CAST(round(CAST(labor_cost AS DOUBLE) / CAST(nullif(regular_hours
  + overtime_hours * CAST(1.5 AS DECIMAL(2,1)), 0) AS DOUBLE), 2) AS DECIMAL(10,2))"""
PAY_SQL = """CAST(round(regular_hours * {rate}
  + overtime_hours * {rate} * CAST(1.5 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2))"""

LABOR_SQL = f"""SELECT *, {flags_sql({
    "project_corrected": "time_entry_id = 'TE000408'",
    "trade_standardized": "trade <> std_trade",
    "trade_unresolved":
        "std_trade NOT IN ('Carpenter', 'Laborer', 'Finisher', 'Superintendent')",
    "date_fallback": "TRY_CAST(work_date AS DATE) IS NULL AND std_work_date IS NOT NULL",
    "date_unparsed": "work_date IS NOT NULL AND std_work_date IS NULL",
    "rate_inferred": "hourly_rate IS NULL AND std_hourly_rate IS NOT NULL",
    "rate_missing": "std_hourly_rate IS NULL",
    "cost_off_by_one_cent": "ABS(cost_difference) = 0.01",
    "cost_unexplained": "ABS(cost_difference) > 0.01",
})} AS flags FROM (SELECT *, CAST(labor_cost - {PAY_SQL.format(rate="std_hourly_rate")}
    AS DECIMAL(18,2)) AS cost_difference
  FROM (SELECT * EXCLUDE (implied), COALESCE(hourly_rate, CASE
    WHEN {PAY_SQL.format(rate="implied")} = labor_cost THEN implied END) AS std_hourly_rate
  FROM (SELECT DISTINCT *,
    CASE WHEN time_entry_id = 'TE000408' THEN 'P003' ELSE project_id END AS std_project_id,
    {TRADE_SQL} AS std_trade, {_date_sql("work_date")} AS std_work_date,
    regular_hours AS std_regular_hours, overtime_hours AS std_overtime_hours,
    labor_cost AS std_labor_cost, {RATE_SQL} AS implied FROM H)))"""

UPDATES_SQL = f"""SELECT *, {flags_sql({
    "date_fallback": "TRY_CAST(report_date AS DATE) IS NULL AND std_report_date IS NOT NULL",
    "date_unparsed": "report_date IS NOT NULL AND std_report_date IS NULL",
    "forecast_missing": "std_forecast_completion_date IS NULL",
    "forecast_before_report": "std_forecast_completion_date < std_report_date",
    "percent_sign": "strpos(actual_pct_complete, '%') > 0",
    "actual_above_100": "std_actual_pct_complete > 100",
    "actual_decreased": "std_actual_pct_complete < previous_actual_pct_complete",
})} AS flags FROM (SELECT *, LAG(std_actual_pct_complete) OVER (PARTITION BY project_id
    ORDER BY std_report_date, update_id) AS previous_actual_pct_complete
  FROM (SELECT DISTINCT *, {_date_sql("report_date")} AS std_report_date,
  CAST(forecast_completion_date AS DATE) AS std_forecast_completion_date,
  TRY_CAST(planned_pct_complete AS DECIMAL(4,1)) AS std_planned_pct_complete,
  TRY_CAST(replace(actual_pct_complete, '%', '') AS DECIMAL(4,1)) AS std_actual_pct_complete
  FROM A))"""


@query(text_sql(PROJECTS_SQL), "OP")
def cleaned_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags_as_text(
        entity_cleaning.clean_projects(entity_views.projects(spark, sf_dir)))


@query(text_sql(BUDGETS_SQL), "OB")
def cleaned_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags_as_text(
        entity_cleaning.clean_budgets(entity_views.budgets(spark, sf_dir)))


@query(text_sql(TRANSACTIONS_SQL), "OT")
def cleaned_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags_as_text(
        entity_cleaning.clean_transactions(entity_views.transactions(spark, sf_dir)))


@query(text_sql(LABOR_SQL), "H")
def cleaned_labor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags_as_text(
        entity_cleaning.clean_labor(entity_views.labor(spark, sf_dir)))


@query(text_sql(UPDATES_SQL), "UA")
def cleaned_project_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags_as_text(
        entity_cleaning.clean_updates(entity_views.updates(spark, sf_dir)))


@query(f"""SELECT UNNEST(flags) AS flag, COUNT(*) AS row_count FROM ({LABOR_SQL}) GROUP BY 1""", "H")
def flag_counts_labor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_counts(entity_cleaning.clean_labor(entity_views.labor(spark, sf_dir)))


@query(f"""SELECT *, CAST(incurred + pending AS DECIMAL(38,2)) AS maximum,
  CAST(all_statuses - (incurred + pending) AS DECIMAL(38,2)) AS unassigned FROM (SELECT
  CAST(COALESCE(SUM(std_amount) FILTER (WHERE std_payment_status IN ('paid', 'approved', 'applied')),
    0) AS DECIMAL(38,2)) AS incurred,
  CAST(COALESCE(SUM(std_amount) FILTER (WHERE std_payment_status = 'pending'), 0)
    AS DECIMAL(38,2)) AS pending,
  CAST(SUM(std_amount) AS DECIMAL(38,2)) AS all_statuses FROM ({TRANSACTIONS_SQL}))""", "OT")
def cost_exposure_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net incurred, pending and maximum cost over cleaned transactions."""
    cleaned = entity_cleaning.clean_transactions(entity_views.transactions(spark, sf_dir))
    return exposure.exposure_summary(cleaned, "std_payment_status", F.col("std_amount"))


@query(f"""WITH c AS ({TRANSACTIONS_SQL}), p AS (SELECT DISTINCT project_id AS p, std_cost_category
    AS k FROM ({BUDGETS_SQL}))
  SELECT DISTINCT std_project_id AS project_id, std_cost_category AS cost_category
  FROM c LEFT JOIN p ON std_project_id = p AND std_cost_category = k WHERE p IS NULL""", "OTB")
def unmatched_transaction_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project and category pairs of cleaned transactions without a cleaned budget line."""
    spent = entity_cleaning.clean_transactions(entity_views.transactions(spark, sf_dir))
    planned = entity_cleaning.clean_budgets(entity_views.budgets(spark, sf_dir))
    return referential.orphan_keys(
        spent.select(F.col("std_project_id").alias("project_id"),
                     F.col("std_cost_category").alias("cost_category")),
        planned.select("project_id", F.col("std_cost_category").alias("cost_category")),
        ["project_id", "cost_category"], include_null=True)


@query(f"""SELECT weekday_number, weekday_name, COUNT(*) AS entity_dates FROM (SELECT DISTINCT
    employee_id, CAST(isodow(std_work_date) AS BIGINT) AS weekday_number,
    dayname(std_work_date) AS weekday_name, std_work_date FROM ({LABOR_SQL})
    WHERE std_work_date IS NOT NULL) GROUP BY 1, 2""", "H")
def weekday_distribution_labor(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = entity_cleaning.clean_labor(entity_views.labor(spark, sf_dir))
    return dates.weekday_distribution(cleaned, "employee_id", F.col("std_work_date"))


@query(f"""SELECT update_id, u.project_id, std_report_date, std_forecast_completion_date,
  std_actual_pct_complete, std_project_status, std_baseline_completion_date
  FROM ({UPDATES_SQL}) u JOIN (SELECT DISTINCT project_id, std_project_status,
    std_baseline_completion_date FROM ({PROJECTS_SQL})) p ON u.project_id = p.project_id
  WHERE std_forecast_completion_date < std_report_date""", "OPUA")
def stale_forecasts_with_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates whose forecast precedes their report date, with the official project state."""
    updates = entity_cleaning.clean_updates(entity_views.updates(spark, sf_dir))
    stale = updates.filter(F.array_contains("flags", "forecast_before_report")).select(
        "update_id", "project_id", "std_report_date", "std_forecast_completion_date",
        "std_actual_pct_complete")
    projects = entity_cleaning.clean_projects(entity_views.projects(spark, sf_dir)).select(
        "project_id", "std_project_status", "std_baseline_completion_date")
    return referential.enrich_join(stale, projects, "project_id")


def _rates_sql(where: str) -> str:
    return f"""SELECT h.* EXCLUDE (rid), 4101::BIGINT AS candidates_tried,
  COUNT(*) OVER (PARTITION BY h.rid) AS matching_candidates, g.candidate
  FROM (SELECT time_entry_id, regular_hours, overtime_hours, hourly_rate, labor_cost, row_number() OVER () AS rid FROM H {where}) h,
  (SELECT CAST(i / 100.0 AS DECIMAL(10,2)) AS candidate FROM range(2700, 6801) t(i)) g
  WHERE {PAY_SQL.format(rate="g.candidate")} = h.labor_cost"""


def _rates(entries: DataFrame) -> DataFrame:
    """All rates from 27.00 to 68.00 in cents that reproduce an entry's cost; pay never falls with the rate."""
    pay = lambda rate: entity_cleaning.labor_cost(
        F.col("regular_hours"), F.col("overtime_hours"), rate.cast("decimal(10,2)"))
    columns = ["time_entry_id", "regular_hours", "overtime_hours", "hourly_rate", "labor_cost"]
    found = rules.candidate_search(entries.select(*columns), 2700, 6800, 2, pay, F.col("labor_cost"), monotone=True)
    return found.withColumn("candidate", F.col("candidate").cast("decimal(10,2)"))


@query(_rates_sql("WHERE hourly_rate IS NULL"), "H")
def candidate_search_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(entity_views.labor(spark, sf_dir).filter(F.col("hourly_rate").isNull()))


@query(f"""SELECT status, COUNT(*) AS entries FROM (SELECT rid, CASE
    WHEN COUNT(candidate) = 0 THEN 'none' WHEN COUNT(*) FILTER (candidate = hourly_rate) = 0 THEN 'others'
    WHEN COUNT(candidate) = 1 THEN 'recorded only' ELSE 'recorded among others' END AS status
  FROM (SELECT regular_hours, overtime_hours, hourly_rate, labor_cost, row_number() OVER () AS rid FROM H WHERE hourly_rate IS NOT NULL) h
  LEFT JOIN (SELECT CAST(i / 100.0 AS DECIMAL(10,2)) AS candidate FROM range(2700, 6801) t(i)) g
  ON {PAY_SQL.format(rate="g.candidate")} = h.labor_cost GROUP BY rid) GROUP BY status""", "H")
def candidate_search_rate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which recorded rates the search would have found, over all entries."""
    entries = entity_views.labor(spark, sf_dir).filter(F.col("hourly_rate").isNotNull())
    found = _rates(entries).groupBy("time_entry_id", "hourly_rate").agg(
        F.first("matching_candidates").alias("n"), F.max((F.col("candidate") == F.col("hourly_rate")).cast("int")).alias("own"))
    status = F.when(F.col("own") == 0, "others").when(F.col("n") == 1, "recorded only").otherwise("recorded among others")
    counted = entries.select("time_entry_id", "hourly_rate").join(found, ["time_entry_id", "hourly_rate"], "left")
    return counted.groupBy(F.when(F.col("n").isNull(), "none").otherwise(status).alias("status")).agg(
        F.count(F.lit(1)).alias("entries"))


def _published(cleaned: DataFrame, key: str) -> DataFrame:
    """The cleaned table as its readers get it: written, checked and published as Parquet."""
    return flags_as_text(publish_cleaned(cleaned, shared_folder(cleaned.sparkSession, f"published-{key}"), unique=[key]))


@query(text_sql(PROJECTS_SQL), "OP")
def published_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(entity_cleaning.clean_projects(entity_views.projects(spark, sf_dir)), "project_id")


@query(text_sql(BUDGETS_SQL), "OB")
def published_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(entity_cleaning.clean_budgets(entity_views.budgets(spark, sf_dir)), "budget_line_id")


@query(text_sql(TRANSACTIONS_SQL), "OT")
def published_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(entity_cleaning.clean_transactions(entity_views.transactions(spark, sf_dir)), "transaction_id")


@query(text_sql(LABOR_SQL), "H")
def published_labor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(entity_cleaning.clean_labor(entity_views.labor(spark, sf_dir)), "time_entry_id")


@query(text_sql(UPDATES_SQL), "UA")
def published_project_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(entity_cleaning.clean_updates(entity_views.updates(spark, sf_dir)), "update_id")
