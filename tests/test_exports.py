"""Published results for two real exports.

Point PROJECTS_EXPORT and CHANGE_ORDERS_EXPORT at the CSV files; without them the tests skip.
"""

import datetime as dt
import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from plumbline.functions import parsing as parse
from plumbline.operators import (
    categorical, completeness, dates, keys, numeric, parsing, referential, rules, structure,
)
from plumbline.plans import entity_cleaning as plans
from plumbline.sources.tables import csv_ingest


def load(spark, variable, typed):
    path = os.environ.get(variable)
    if not path:
        pytest.skip(f"{variable} is not set")
    return csv_ingest(spark, path, typed=typed)


@pytest.fixture(scope="module")
def projects(spark):
    return load(spark, "PROJECTS_EXPORT", True)


@pytest.fixture(scope="module")
def orders(spark):
    return load(spark, "CHANGE_ORDERS_EXPORT", True)


def one(df):
    (row,) = df.collect()
    return row.asDict()


def test_project_schema(projects):
    types = {r["column_name"]: r["column_type"] for r in structure.schema_profile(projects).collect()}
    assert types["baseline_completion_date"] == "VARCHAR"
    assert types["original_contract_value"] == "VARCHAR"
    assert types["baseline_start_date"] == types["actual_completion_date"] == "DATE"


def test_project_keys(projects):
    got = one(keys.key_profile(projects, "project_id"))
    assert (got["row_count"], got["distinct_keys"], got["surplus_rows"]) == (97, 96, 1)
    duplicate = one(keys.duplicate_classification(projects, "project_id"))
    assert (duplicate["project_id"], duplicate["duplicate_kind"]) == ("P042", "exact")


def test_project_completeness(projects):
    nulls = {r["column_name"]: r["null_count"] for r in completeness.null_profile(projects).collect()}
    assert nulls.pop("actual_completion_date") == 21
    assert nulls.pop("project_type") == 1
    assert set(nulls.values()) == {0}
    assert one(completeness.missing_rows(projects, "project_type"))["project_id"] == "P052"


def test_project_values(projects):
    labels = {r["value"] for r in categorical.value_frequency(projects, "project_status").collect()}
    assert labels == {"active", " active ", "completed", "Complete", "on_hold", "On Hold"}
    variants = categorical.variant_rows(projects, "project_manager", ["Elena Martinez"])
    assert one(variants)["project_manager"] == "Elena Martinez "
    date = F.col("baseline_completion_date")
    failed = one(parsing.parse_failures(projects, "baseline_completion_date", parse.parse_ymd(date), "d"))
    assert (failed["project_id"], failed["baseline_completion_date"]) == ("P013", "8/10/2023")
    money = parse.to_decimal(F.col("original_contract_value"), 18, 2)
    failed = one(parsing.parse_failures(projects, "original_contract_value", money, "m"))
    assert (failed["project_id"], failed["original_contract_value"]) == ("P066", "$672,000")


def test_project_ranges_and_rules(projects):
    value = parse.normalize_money(F.col("original_contract_value"))
    rows = projects.withColumn("value", value).withColumn(
        "done", parse.parse_ymd(F.col("baseline_completion_date")))
    got = {r["column_name"]: r for r in numeric.range_profile(
        rows, ["value", "original_budget"], 0).collect()}
    assert (got["value"]["minimum"], got["value"]["maximum"]) == (276000, 3773000)
    assert (got["original_budget"]["minimum"], got["original_budget"]["maximum"]) == (223600, 2917000)
    latest = one(dates.date_range_profile(rows, {"done": F.col("done")}, dt.date(2026, 6, 30)))
    assert latest["latest"] == dt.date(2026, 12, 18)
    for first, second in (("original_budget", "value"), ("baseline_start_date", "done"),
                          ("actual_start_date", "actual_completion_date")):
        assert rules.order_violations(rows, F.col(first), F.col(second)).count() == 0


def test_cleaned_projects(projects):
    cleaned = {r["project_id"]: r for r in plans.clean_projects(projects).collect()}
    assert len(cleaned) == 96
    assert {r["std_project_status"] for r in cleaned.values()} == {"active", "completed", "on_hold"}
    assert cleaned["P066"]["std_original_contract_value"] == D("672000.00")
    assert "baseline_completion_unconfirmed" in cleaned["P013"]["flags"]
    assert cleaned["P052"]["std_project_type"] == "unknown"


def test_change_orders(orders, projects):
    got = one(keys.key_profile(orders, "change_order_id"))
    assert (got["row_count"], got["distinct_keys"]) == (146, 145)
    duplicate = one(keys.duplicate_classification(orders, "change_order_id"))
    assert (duplicate["change_order_id"], duplicate["duplicate_kind"]) == ("CO0013", "exact")
    nulls = {r["column_name"]: r["null_count"] for r in completeness.null_profile(orders).collect()}
    assert (nulls["approved_revenue_change"], nulls["approval_date"]) == (43, 44)
    assert (nulls["billed_amount"], nulls["billed_date"]) == (43, 67)
    kinds = {r["value"]: r["row_count"] for r in
             categorical.value_frequency(orders, "change_order_type").collect()}
    assert kinds == {"additive": 134, "deductive": 12}
    variants = categorical.variant_rows(orders, "status", ["approved", "pending"])
    assert {r["status"] for r in variants.collect()} == {"Approved", "PENDING "}
    money = parse.to_decimal(F.col("requested_revenue_change"), 18, 2)
    failed = one(parsing.parse_failures(orders, "requested_revenue_change", money, "m"))
    assert failed["requested_revenue_change"] == "$43,428.72"
    assert one(referential.orphan_keys(orders, projects, "project_id")) == {"project_id": "P994"}
    late = one(dates.date_range_profile(orders, {"billed": F.col("billed_date")}, dt.date(2026, 6, 30)))
    assert late["after_cutoff"] == 1
