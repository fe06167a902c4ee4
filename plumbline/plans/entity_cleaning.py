"""Cleaning plans for the contractor exports: projects, budgets, transactions, labor, updates.

The rules are the confirmed decisions; corrections of single records are arguments, so that the
same plan serves the next delivery of an export.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import parsing as parse
from plumbline.functions.text import folded, mapped
from plumbline.operators.cleaning import CleaningPlan, apply_plan, clean
from plumbline.operators.keys import dedup_exact, require_consistent
from plumbline.operators.ordering import with_neighbors
from plumbline.sources.tables import written

# Standard labels, found by lower case without outer spaces.
PROJECT_STATUSES = {
    "active": "active",
    "completed": "completed",
    "complete": "completed",
    "on_hold": "on_hold",
    "on hold": "on_hold",
}
COST_CATEGORIES = {
    "general conditions": "General Conditions",
    "labor": "Labor",
    "materials": "Materials",
    "sub-contractor": "Subcontractors",
    "sub-contractors": "Subcontractors",
    "subcontractors": "Subcontractors",
}
TRADES = {
    "carpenter": "Carpenter",
    "laborer": "Laborer",
    "finisher": "Finisher",
    "superintendent": "Superintendent",
}
PAYMENT_STATUSES = ("paid", "approved", "pending", "applied")

# Confirmed corrections of the project on single records.
TRANSACTION_PROJECTS = {"TX000316": "P003", "TX000729": "P007"}
LABOR_PROJECTS = {"TE000408": "P003"}

OVERTIME_FACTOR = 1.5
MONEY = (10, 2)


def _changed(raw: Column, standard: Column) -> Column:
    return raw.isNotNull() & standard.isNotNull() & (raw != standard)


def _reformatted(raw: Column, parsed: Column, precision: int, scale: int) -> Column:
    return parsed.isNotNull() & parse.to_decimal(raw, precision, scale).isNull()


def _corrected(key: str, column: str, fixes: Mapping[str, str]) -> tuple[Column, Column]:
    fix = mapped(F.col(key), fixes)
    known = F.lit(False) if not fixes else F.col(key).isin(*fixes)
    return F.coalesce(fix, F.col(column)).cast("string"), known


def projects_plan() -> CleaningPlan:
    """Status labels, contract value as money, completion date only where it is unambiguous."""
    status, value = F.col("project_status"), F.col("original_contract_value").cast("string")
    done, kind = F.col("baseline_completion_date").cast("string"), F.col("project_type")
    std_status = mapped(folded(status), PROJECT_STATUSES)
    return CleaningPlan(
        key="project_id",
        standard={
            "std_project_status": std_status,
            "std_project_type": F.coalesce(F.trim(kind), F.lit("unknown")),
            "std_baseline_completion_date": parse.parse_ymd(done),
            "std_original_contract_value": parse.normalize_money(value, 18, 2),
            "std_original_budget": F.col("original_budget").try_cast("decimal(18,2)"),
        },
        flags={
            "status_standardized": _changed(status, std_status),
            "status_unknown": std_status.isNull(),
            "type_unknown": kind.isNull(),
            "baseline_completion_unconfirmed":
                done.isNotNull() & F.col("std_baseline_completion_date").isNull(),
            "contract_value_reformatted":
                _reformatted(value, F.col("std_original_contract_value"), 18, 2),
        },
    )


def budgets_plan() -> CleaningPlan:
    """Categories, money, and a candidate for a missing original amount kept apart."""
    category, change = F.col("cost_category"), F.col("approved_budget_change").cast("string")
    std_category = mapped(folded(category), COST_CATEGORIES, F.trim(category))
    original = F.col("original_budget_amount").try_cast("decimal(10,2)")
    return CleaningPlan(
        key="budget_line_id",
        standard={
            "std_cost_category": std_category,
            "std_original_budget_amount": original,
            "std_approved_budget_change": parse.normalize_money(change, *MONEY),
            "std_revised_budget_amount": F.col("revised_budget_amount").try_cast("decimal(10,2)"),
        },
        derived={
            "inferred_original_budget_amount": F.when(
                F.col("std_original_budget_amount").isNull(),
                (F.col("std_revised_budget_amount") - F.col("std_approved_budget_change"))
                .try_cast("decimal(10,2)"),
            ),
        },
        flags={
            "category_standardized": _changed(category, std_category),
            "change_reformatted": _reformatted(
                change, F.col("std_approved_budget_change"), *MONEY),
            "original_budget_missing": F.col("original_budget_amount").isNull(),
            "original_budget_inferred": F.col("inferred_original_budget_amount").isNotNull(),
        },
    )


def transactions_plan(fixes: Mapping[str, str] = TRANSACTION_PROJECTS) -> CleaningPlan:
    """Project corrections, categories, statuses and amounts; credits keep their sign."""
    category, status = F.col("cost_category"), F.col("payment_status")
    amount = F.col("amount").cast("string")
    project, corrected = _corrected("transaction_id", "project_id", fixes)
    std_category = mapped(folded(category), COST_CATEGORIES, F.trim(category))
    return CleaningPlan(
        key="transaction_id",
        standard={
            "std_project_id": project,
            "std_cost_category": std_category,
            "std_payment_status": folded(status),
            "std_amount": parse.normalize_money(amount, *MONEY),
        },
        flags={
            "project_corrected": corrected,
            "project_missing": F.col("std_project_id").isNull(),
            "category_standardized": _changed(category, std_category),
            "status_standardized": _changed(status, folded(status)),
            "status_unknown": ~F.col("std_payment_status").isin(*PAYMENT_STATUSES),
            "amount_reformatted": _reformatted(amount, F.col("std_amount"), *MONEY),
            "amount_unparsed": amount.isNotNull() & F.col("std_amount").isNull(),
            "credit": F.col("std_amount") < 0,
        },
    )


def labor_cost(regular: Column, overtime: Column, rate: Column) -> Column:
    """Regular and overtime pay, rounded once."""
    factor = F.lit(OVERTIME_FACTOR).cast("decimal(2,1)")
    return F.round(regular * rate + overtime * rate * factor, 2)


def labor_plan(fixes: Mapping[str, str] = LABOR_PROJECTS) -> CleaningPlan:
    """Dates, trades, project corrections, and a rate that the recorded cost implies.

    An implied rate is used only where it reproduces the cost. Cost differences stay as they are.
    """
    trade, date = F.col("trade"), F.col("work_date").cast("string")
    project, corrected = _corrected("time_entry_id", "project_id", fixes)
    regular = F.col("regular_hours").try_cast("decimal(10,4)")
    overtime = F.col("overtime_hours").try_cast("decimal(10,2)")
    cost = F.col("labor_cost").try_cast("decimal(10,2)")
    raw_rate = F.col("hourly_rate").try_cast("decimal(10,2)")
    paid = regular + overtime * F.lit(OVERTIME_FACTOR).cast("decimal(2,1)")
    implied = F.round(F.try_divide(cost, paid), 2).try_cast("decimal(10,2)")
    usable = F.when(labor_cost(regular, overtime, implied) == cost, implied)
    difference = F.col("std_labor_cost") - labor_cost(
        F.col("std_regular_hours"), F.col("std_overtime_hours"), F.col("std_hourly_rate"))
    return CleaningPlan(
        key="time_entry_id",
        standard={
            "std_project_id": project,
            "std_trade": mapped(folded(trade), TRADES, F.trim(trade)),
            "std_work_date": parse.parse_date_fallback(date),
            "std_regular_hours": regular,
            "std_overtime_hours": overtime,
            "std_hourly_rate": F.coalesce(raw_rate, usable),
            "std_labor_cost": cost,
        },
        derived={"cost_difference": difference.cast("decimal(18,2)")},
        flags={
            "project_corrected": corrected,
            "trade_standardized": _changed(trade, F.col("std_trade")),
            "trade_unresolved": trade.isNotNull() & ~F.col("std_trade").isin(*TRADES.values()),
            "date_fallback": parse.needed_fallback(date),
            "date_unparsed": date.isNotNull() & F.col("std_work_date").isNull(),
            "rate_inferred":
                F.col("hourly_rate").isNull() & F.col("std_hourly_rate").isNotNull(),
            "rate_missing": F.col("std_hourly_rate").isNull(),
            "cost_off_by_one_cent": F.abs("cost_difference") == F.lit(0.01).cast("decimal(3,2)"),
            "cost_unexplained": F.abs("cost_difference") > F.lit(0.01).cast("decimal(3,2)"),
        },
    )


def updates_plan() -> CleaningPlan:
    """Report date, forecast as a date, percentages with one decimal; odd values stay, flagged."""
    report, actual = F.col("report_date").cast("string"), F.col("actual_pct_complete").cast("string")
    return CleaningPlan(
        key="update_id",
        standard={
            "std_report_date": parse.parse_date_fallback(report),
            "std_forecast_completion_date": F.col("forecast_completion_date").cast("date"),
            "std_planned_pct_complete":
                F.col("planned_pct_complete").cast("string").try_cast("decimal(4,1)"),
            "std_actual_pct_complete": parse.normalize_percent(actual, 4, 1),
        },
        flags={
            "date_fallback": parse.needed_fallback(report),
            "date_unparsed": report.isNotNull() & F.col("std_report_date").isNull(),
            "forecast_missing": F.col("std_forecast_completion_date").isNull(),
            "forecast_before_report":
                F.col("std_forecast_completion_date") < F.col("std_report_date"),
            "percent_sign": parse.has_percent_sign(actual),
            "actual_above_100": F.col("std_actual_pct_complete") > 100,
            "actual_decreased":
                F.col("std_actual_pct_complete") < F.col("previous_actual_pct_complete"),
        },
    )


def clean_projects(rows: DataFrame) -> DataFrame:
    return clean(rows, projects_plan())


def clean_budgets(rows: DataFrame) -> DataFrame:
    return clean(rows, budgets_plan())


def clean_transactions(
    rows: DataFrame, fixes: Mapping[str, str] = TRANSACTION_PROJECTS
) -> DataFrame:
    return clean(rows, transactions_plan(fixes))


def clean_labor(rows: DataFrame, fixes: Mapping[str, str] = LABOR_PROJECTS) -> DataFrame:
    return clean(rows, labor_plan(fixes))


def clean_updates(rows: DataFrame) -> DataFrame:
    """As the other tables, after linking each update to the one before it in its project."""
    unique = written(dedup_exact(rows), "unique-updates")
    require_consistent(unique, "update_id")
    report = parse.parse_date_fallback(F.col("report_date").cast("string"))
    actual = parse.normalize_percent(F.col("actual_pct_complete").cast("string"), 4, 1)
    dated = unique.withColumns({"_report": report, "_actual": actual})
    linked = with_neighbors(
        dated, ["_report", "update_id"], previous={"previous_actual_pct_complete": "_actual"},
        by=["project_id"])
    return apply_plan(linked.drop("_report", "_actual"), updates_plan())
