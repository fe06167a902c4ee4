"""Known counts of the defect views at scale factor 0.01."""

from pathlib import Path

import pytest

from conftest import DATA
from plumbline.plans.catalogue import QUERIES

FOLDER = f"{DATA}/sf0.01"


def one(spark, name):
    if not Path(FOLDER).exists():
        pytest.skip("no test tables")
    (row,) = QUERIES[name].run(spark, FOLDER).collect()
    return row.asDict()


def rows(spark, name):
    return QUERIES[name].run(spark, FOLDER).count()


def test_orders(spark):
    profile = one(spark, "key_profile_orders")
    assert (profile["row_count"], profile["distinct_keys"]) == (15016, 15000)
    assert rows(spark, "missing_rows_orders") == 32
    assert rows(spark, "variant_rows_status") == 140
    assert rows(spark, "parse_failures_price") == 116
    assert rows(spark, "parse_failures_date") == 102
    assert rows(spark, "duplicate_keys_lineitem") == 11785


def test_lines(spark):
    fit = one(spark, "rule_reconciliation_lines")
    assert (fit["matching"], fit["mismatching"], fit["untestable"]) == (57515, 2319, 166)
    assert fit["reconciles"]
    overlap = one(spark, "formula_overlap_lines")
    assert (overlap["both"], overlap["second_only"], overlap["neither"]) == (44747, 109, 2210)
    assert rows(spark, "order_violations_shipments") == 29157


def test_updates(spark):
    profile = one(spark, "variance_profile_updates")
    assert (profile["ahead"], profile["on_plan"], profile["behind"]) == (3333, 1111, 5556)
    assert rows(spark, "monotonic_violations_actual") == 2655
    assert rows(spark, "monotonic_violations_planned") == 0
    assert rows(spark, "business_grain_check_events") == 2897
    assert rows(spark, "block_starts_events") == 7979


def test_exposure_counts_every_row(spark):
    found = QUERIES["status_exposure_orders"].run(spark, FOLDER).collect()
    assert sum(r["row_count"] for r in found) == 15016
    summary = one(spark, "exposure_summary_orders")
    assert sum(r["net_amount"] for r in found) == summary["all_statuses"]


def test_orphan_rows(spark):
    orphans = QUERIES["orphan_counts_customers"].run(spark, FOLDER).collect()
    assert sum(r["row_count"] for r in orphans if r["o_custkey"] is not None) == 48
