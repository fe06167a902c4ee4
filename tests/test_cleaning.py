"""The cleaning plans on small tables with the defects each export is known for."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from plumbline.operators.cleaning import CleaningPlan, apply_plan, flag_counts
from plumbline.operators.keys import ConflictingDuplicates
from plumbline.plans import entity_cleaning as plans
from plumbline.sources import tables
from plumbline.sources.tables import NotPublished, csv_ingest, publish_cleaned, shared_folder, write_cleaned, written


def by_key(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_projects(spark):
    df = spark.createDataFrame(
        [("P1", " active ", "T", "2023-08-10", "672000", 1), ("P1", " active ", "T", "2023-08-10", "672000", 1),
         ("P2", "Complete", None, "8/10/2023", "$672,000", 2), ("P3", "On Hold", "T", None, "1", 3),
         ("P4", "paused", "T", "2023-01-01", "x", 4)],
        "project_id string, project_status string, project_type string, "
        "baseline_completion_date string, original_contract_value string, original_budget int")
    cleaned = plans.clean_projects(df)
    got = by_key(cleaned, "project_id")
    assert cleaned.count() == 4
    assert got["P1"]["std_project_status"] == "active"
    assert got["P1"]["project_status"] == " active "
    assert got["P1"]["flags"] == ["status_standardized"]
    assert got["P2"]["std_original_contract_value"] == D("672000.00")
    assert got["P2"]["std_baseline_completion_date"] is None
    assert got["P2"]["std_project_type"] == "unknown"
    assert got["P2"]["flags"] == ["status_standardized", "type_unknown",
                                  "baseline_completion_unconfirmed", "contract_value_reformatted"]
    assert got["P3"]["std_project_status"] == "on_hold"
    assert got["P4"]["flags"] == ["status_unknown"]
    assert {r["flag"]: r["row_count"] for r in flag_counts(cleaned).collect()}["type_unknown"] == 1


def test_budgets(spark):
    df = spark.createDataFrame(
        [("B1", "P1", "Sub-Contractors", 100, "$3,485.49", 3585.49), ("B2", "P1", "labor", None, "0", 31672.0),
         ("B3", "P1", "Permits ", 5, "1", 6.0)],
        "budget_line_id string, project_id string, cost_category string, "
        "original_budget_amount bigint, approved_budget_change string, revised_budget_amount double")
    got = by_key(plans.clean_budgets(df), "budget_line_id")
    assert got["B1"]["std_cost_category"] == "Subcontractors"
    assert got["B1"]["std_approved_budget_change"] == D("3485.49")
    assert got["B1"]["flags"] == ["category_standardized", "change_reformatted"]
    assert got["B2"]["std_original_budget_amount"] is None
    assert got["B2"]["inferred_original_budget_amount"] == D("31672.00")
    assert got["B2"]["flags"] == ["category_standardized", "original_budget_missing",
                                  "original_budget_inferred"]
    assert got["B3"]["std_cost_category"] == "Permits"


def test_transactions(spark):
    df = spark.createDataFrame(
        [("TX000316", None, "Labor", "$46.90", "paid"), ("TX000729", "P998", "materials ", "10", "Paid "),
         ("TX1", "P1", "Sub-Contractor", "-1800", "applied"), ("TX2", "P1", "Labor", "n/a", "odd")],
        "transaction_id string, project_id string, cost_category string, amount string, "
        "payment_status string")
    got = by_key(plans.clean_transactions(df), "transaction_id")
    assert got["TX000316"]["std_project_id"] == "P003"
    assert got["TX000316"]["project_id"] is None
    assert got["TX000316"]["flags"] == ["project_corrected", "amount_reformatted"]
    assert got["TX000729"]["std_project_id"] == "P007"
    assert got["TX000729"]["flags"] == ["project_corrected", "category_standardized",
                                        "status_standardized"]
    assert got["TX1"]["std_amount"] == D("-1800.00")
    assert got["TX1"]["flags"] == ["category_standardized", "credit"]
    assert got["TX2"]["flags"] == ["status_unknown", "amount_unparsed"]
    plain = by_key(plans.clean_transactions(df, fixes={}), "transaction_id")
    assert plain["TX000316"]["flags"] == ["project_missing", "amount_reformatted"]


def test_labor(spark):
    df = spark.createDataFrame(
        [("TE1", "P1", "carpenter ", "5/19/2023", 40.0, 2.0, 30.0, 1290.0),
         ("TE000408", "P996", "Finisher", "2023-05-19", 1.0, 0.0, 30.0, 29.99),
         ("TE3", "P1", "General Labor", "2023-05-19", 43.57, 0.0, None, 1697.49),
         ("TE4", "P1", "Laborer", "2023-05-19", 40.0, 0.0, 30.0, 1325.0),
         ("TE5", "P1", "Laborer", "x", 0.0, 0.0, None, 10.0)],
        "time_entry_id string, project_id string, trade string, work_date string, "
        "regular_hours double, overtime_hours double, hourly_rate double, labor_cost double")
    got = by_key(plans.clean_labor(df), "time_entry_id")
    assert got["TE1"]["std_work_date"] == dt.date(2023, 5, 19)
    assert got["TE1"]["flags"] == ["trade_standardized", "date_fallback"]
    assert got["TE000408"]["std_project_id"] == "P003"
    assert got["TE000408"]["flags"] == ["project_corrected", "cost_off_by_one_cent"]
    assert got["TE3"]["std_hourly_rate"] == D("38.96")
    assert got["TE3"]["hourly_rate"] is None
    assert got["TE3"]["flags"] == ["trade_unresolved", "rate_inferred"]
    assert got["TE4"]["cost_difference"] == D("125.00")
    assert got["TE4"]["flags"] == ["cost_unexplained"]
    assert got["TE5"]["flags"] == ["date_unparsed", "rate_missing"]


def test_updates(spark):
    ts = dt.datetime
    df = spark.createDataFrame(
        [("U1", "P1", "8/31/2024", "50.9", 50.0, ts(2024, 12, 1)),
         ("U2", "P1", "2024-09-30", "105", 65.4, ts(2024, 9, 1)),
         ("U3", "P1", "2024-10-31", "89.7%", 80.0, None),
         ("U3", "P1", "2024-10-31", "89.7%", 80.0, None),
         ("U4", "P2", "2024-10-31", "10", 8.8, ts(2024, 12, 1))],
        "update_id string, project_id string, report_date string, actual_pct_complete string, "
        "planned_pct_complete double, forecast_completion_date timestamp_ntz")
    cleaned = plans.clean_updates(df)
    got = by_key(cleaned, "update_id")
    assert cleaned.count() == 4
    assert got["U1"]["std_report_date"] == dt.date(2024, 8, 31)
    assert got["U1"]["flags"] == ["date_fallback"]
    assert got["U2"]["std_actual_pct_complete"] == D("105.0")
    assert got["U2"]["flags"] == ["forecast_before_report", "actual_above_100"]
    assert got["U3"]["flags"] == ["forecast_missing", "percent_sign", "actual_decreased"]
    assert got["U4"]["flags"] == []


def test_conflicting_rows_are_refused(spark):
    df = spark.createDataFrame(
        [("P1", "active", "T", None, "1", 1), ("P1", "active", "T", None, "2", 1)],
        "project_id string, project_status string, project_type string, "
        "baseline_completion_date string, original_contract_value string, original_budget int")
    with pytest.raises(ConflictingDuplicates):
        plans.clean_projects(df)


def test_raw_columns_cannot_be_replaced(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        apply_plan(df, CleaningPlan(key="k", standard={"v": F.lit(1)}, flags={}))


def test_sink_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, " a", "x"), (2, None, "y")], "k int, v string, p string")
    raw = str(tmp_path / "raw")
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(raw)
    back = csv_ingest(spark, raw)
    assert [f.dataType.simpleString() for f in back.schema] == ["string"] * 3
    assert sorted(map(tuple, back.collect())) == [("1", " a", "x"), ("2", None, "y")]
    typed = csv_ingest(spark, raw, typed=True)
    assert typed.schema["k"].dataType.simpleString() == "int"
    given = csv_ingest(spark, raw, schema="k bigint, v string, p string")
    assert given.schema["k"].dataType.simpleString() == "bigint"
    cleaned = write_cleaned(df, str(tmp_path / "out"), [raw], partition_by=["p"])
    assert cleaned.count() == 2
    with pytest.raises(ValueError):
        write_cleaned(df, raw + "/inside", [raw])


def test_shared_folder_follows_the_session(spark, shared):
    assert shared_folder(spark, "x").startswith(f"{shared}/x-")
    df = written(spark.range(3), "numbers")
    assert df.count() == 3
    assert df.inputFiles()[0].startswith(f"file://{shared}/numbers-")


def test_publishing_is_all_or_nothing(spark, tmp_path, monkeypatch):
    import os

    df = spark.createDataFrame([(1, " a", ["x"], "p"), (2, None, [], "q"), (None, "", None, "q")],
                               "k int, v string, flags array<string>, part string")
    path = str(tmp_path / "cleaned")
    got = publish_cleaned(df, path, unique=["k"], partition_by=["part"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert os.listdir(tmp_path) == ["cleaned"] and os.path.exists(f"{path}/_SUCCESS")
    with pytest.raises(NotPublished, match="exists"):
        publish_cleaned(df, path)
    with pytest.raises(NotPublished, match="more than once"):
        publish_cleaned(df.unionAll(df), str(tmp_path / "twice"), unique=["k"])
    stop = df.withColumn("k", F.when(F.col("k") == 2, F.raise_error(F.lit("no")).cast("int")).otherwise(F.col("k")))
    with pytest.raises(Exception, match="no"):
        publish_cleaned(stop, str(tmp_path / "broken"))
    whole = tables.write_cleaned
    monkeypatch.setattr(tables, "write_cleaned", lambda *a, **b: whole(*a, **b).limit(2))
    with pytest.raises(NotPublished, match="2 of 3 rows"):
        publish_cleaned(df, str(tmp_path / "short"))
    assert os.listdir(tmp_path) == ["cleaned"]
