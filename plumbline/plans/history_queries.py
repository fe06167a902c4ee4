"""Ordered histories, references between tables and exposure on the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.parsing import normalize_money, normalize_percent
from plumbline.functions.text import folded, mapped
from plumbline.operators import exposure, referential, sequence
from plumbline.plans.registry import query
from plumbline.plans.tables import table
from plumbline.plans.value_queries import CLEAN_MONEY, STATUSES
from plumbline.plans.views import orders_view, updates_view

# Fixed value: the report date whose falls are looked at on their own.
AT_DATE = dt.date(2024, 1, 15)

ALL_EVENTS = ["event_id", "user_id", "event_type", "ts"]


@query("""SELECT event_id, event_type, previous_value FROM (SELECT event_id, event_type,
  LAG(event_type) OVER (ORDER BY event_id) AS previous_value FROM events
  WHERE event_type IS NOT NULL) WHERE event_type IS DISTINCT FROM previous_value""")
def block_starts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sequence.block_starts(events, ["event_id"], "event_type")


@query("""SELECT * FROM (SELECT event_id, user_id, event_type, ts,
  LAG(event_type) OVER (ORDER BY event_id) AS previous_value,
  LEAD(event_type) OVER (ORDER BY event_id) AS next_value FROM events)
  WHERE event_type = 'error'""")
def neighbor_context_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(*ALL_EVENTS)
    return sequence.neighbor_context(
        events, ["event_id"], "event_type", F.col("event_type") == "error")


@query("""SELECT * FROM (SELECT event_id, user_id, event_type, ts,
  LAG(user_id) OVER (ORDER BY ts, event_id) AS previous_value,
  LEAD(user_id) OVER (ORDER BY ts, event_id) AS next_value FROM events)""")
def neighbor_context_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(*ALL_EVENTS)
    return sequence.neighbor_context(events, ["ts", "event_id"], "user_id")


@query("SELECT * FROM orders WHERE o_orderkey BETWEEN 5000 AND 6000")
def key_window_rows_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.key_window_rows(table(spark, sf_dir, "orders"), "o_orderkey", 5000, 6000)


FALLS_SQL = """SELECT event_id, user_id, ts, {c}, previous_value,
  CAST(previous_value - {c} AS DECIMAL(6,1)) AS decrease FROM (SELECT *,
  LAG({c}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_value FROM U)
  WHERE {c} < previous_value"""


@query(FALLS_SQL.format(c="actual_pct"), "U")
def monotonic_violations_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = updates_view(spark, sf_dir, written=True).select(
        "event_id", "user_id", "ts", "actual_pct")
    return sequence.monotonic_violations(rows, "user_id", ["ts", "event_id"], "actual_pct")


@query(FALLS_SQL.format(c="planned_pct"), "U")
def monotonic_violations_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = updates_view(spark, sf_dir, written=True).select(
        "event_id", "user_id", "ts", "planned_pct")
    return sequence.monotonic_violations(rows, "user_id", ["ts", "event_id"], "planned_pct")


HISTORY_SQL = """WITH fell AS (SELECT DISTINCT user_id FROM (SELECT *,
  LAG(actual_pct) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_value FROM U)
  WHERE actual_pct < previous_value {at})
  SELECT U.* FROM U JOIN fell USING (user_id)"""


@query(HISTORY_SQL.format(at=f"AND report_date = DATE '{AT_DATE}'"), "U")
def affected_histories_at_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.affected_histories(
        updates_view(spark, sf_dir, written=True), "user_id", ["ts", "event_id"], "actual_pct",
        at={"report_date": AT_DATE})


@query(HISTORY_SQL.format(at=""), "U")
def affected_histories_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.affected_histories(
        updates_view(spark, sf_dir, written=True), "user_id", ["ts", "event_id"], "actual_pct")


@query("""SELECT *, CAST(actual_pct - planned_pct AS DECIMAL(6,1)) AS variance FROM U
  WHERE user_id = 7""", "U")
def entity_history_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.entity_history(
        updates_view(spark, sf_dir), "user_id", 7, ["ts", "event_id"],
        variance=("actual_pct", "planned_pct"))


@query("""SELECT COUNT(*) AS unique_rows, COUNT(v) AS testable,
  COUNT(*) FILTER (WHERE v > 0) AS ahead, COUNT(*) FILTER (WHERE v = 0) AS on_plan,
  COUNT(*) FILTER (WHERE v < 0) AS behind, MIN(v) AS min_variance, MAX(v) AS max_variance
  FROM (SELECT DISTINCT event_id, CAST(actual_pct - planned_pct AS DECIMAL(6,1)) AS v FROM U)""",
       "U")
def variance_profile_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.variance_profile(
        updates_view(spark, sf_dir), "event_id", "actual_pct", "planned_pct")


@query("""SELECT DISTINCT o_custkey FROM O LEFT JOIN customer ON o_custkey = c_custkey
  WHERE o_custkey IS NOT NULL AND c_custkey IS NULL""", "O")
def orphan_keys_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referential.orphan_keys(
        orders_view(spark, sf_dir), table(spark, sf_dir, "customer"),
        "o_custkey", "c_custkey")


@query("""SELECT DISTINCT o_custkey, status_raw FROM O
  LEFT JOIN (SELECT DISTINCT o_custkey AS k, o_orderstatus AS s FROM orders)
  ON o_custkey = k AND status_raw = s
  WHERE k IS NULL AND o_custkey IS NOT NULL AND status_raw IS NOT NULL""", "O")
def orphan_keys_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referential.orphan_keys(
        orders_view(spark, sf_dir), table(spark, sf_dir, "orders"),
        ["o_custkey", "status_raw"], ["o_custkey", "o_orderstatus"])


@query("""SELECT o_custkey, COUNT(*) AS row_count FROM O
  LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL GROUP BY o_custkey""", "O")
def orphan_counts_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referential.orphan_counts(
        orders_view(spark, sf_dir), table(spark, sf_dir, "customer"),
        "o_custkey", "c_custkey")


@query("""WITH c AS (SELECT CASE WHEN o_custkey >= 1000000000 THEN o_custkey - 1000000000
    ELSE o_custkey END AS custkey, CASE LOWER(TRIM(status_raw)) WHEN 'f' THEN 'F' WHEN 'o' THEN 'O'
    WHEN 'p' THEN 'P' ELSE TRIM(status_raw) END AS status FROM O),
  p AS (SELECT DISTINCT o_custkey AS k, o_orderstatus AS s FROM orders)
  SELECT DISTINCT custkey, status FROM c LEFT JOIN p ON custkey = k AND status = s
  WHERE k IS NULL""", "O")
def standardized_orphans_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted customer keys and status variants find their parents; blank ones still do not."""
    raw_key, raw_status = F.col("o_custkey"), F.col("status_raw")
    custkey = F.when(raw_key >= 1_000_000_000, raw_key - 1_000_000_000).otherwise(raw_key)
    status = mapped(folded(raw_status), STATUSES, F.trim(raw_status))
    return referential.standardized_orphans(
        orders_view(spark, sf_dir), table(spark, sf_dir, "orders"),
        {"custkey": (custkey, F.col("o_custkey")), "status": (status, F.col("o_orderstatus"))})


@query("""SELECT 'orders' AS table_name, COUNT(*) AS row_count FROM orders WHERE o_custkey = 42
  UNION ALL SELECT 'customer', COUNT(*) FROM customer WHERE c_custkey = 42
  UNION ALL SELECT 'events', COUNT(*) FROM events WHERE user_id = 42""")
def key_presence_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"orders": "o_custkey", "customer": "c_custkey", "events": "user_id"}
    return referential.key_presence(
        {t: (table(spark, sf_dir, t), c) for t, c in tables.items()}, 42)


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
  WHERE o_custkey IN (1, 42, 99)""")
def lookup_rows_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referential.lookup_rows(
        table(spark, sf_dir, "orders"), "o_custkey", [1, 42, 99],
        ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("""SELECT o_orderkey, o_custkey FROM orders
  WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def lookup_rows_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    overdrawn = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") < 0)
    return referential.lookup_rows(
        table(spark, sf_dir, "orders"), "o_custkey", overdrawn.select("c_custkey"),
        ["o_orderkey", "o_custkey"])


@query("""WITH dim AS (SELECT DISTINCT c_custkey AS user_id, c_mktsegment AS segment,
    CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer)
  SELECT U.event_id, user_id, U.report_date,
  TRY_CAST(replace(pct_text, '%', '') AS DECIMAL(5,1)) AS std_actual_pct, segment, balance
  FROM U JOIN dim USING (user_id) WHERE actual_pct < planned_pct""", "U")
def enrich_join_late_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates behind plan with their customer's attributes; unknown customers drop out."""
    flagged = updates_view(spark, sf_dir).filter(F.col("actual_pct") < F.col("planned_pct")).select(
        "event_id", "user_id", "report_date",
        normalize_percent(F.col("pct_text"), 5, 1).alias("std_actual_pct"))
    dim = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("balance"))
    return referential.enrich_join(flagged, dim, "user_id")


@query("""SELECT COUNT(*) AS fact_rows, COUNT(c_custkey) AS matched_rows,
  COUNT(*) - COUNT(c_custkey) AS unmatched_rows
  FROM O LEFT JOIN customer ON o_custkey = c_custkey""", "O")
def enrich_report_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return referential.enrich_report(orders_view(spark, sf_dir), dim, "o_custkey")


@query(f"""SELECT LOWER(TRIM(status_raw)) AS status, COUNT(*) AS row_count,
  CAST(SUM({CLEAN_MONEY}) AS DECIMAL(38,2)) AS net_amount FROM O GROUP BY 1""", "O")
def status_exposure_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.status_exposure(
        orders_view(spark, sf_dir), "status_raw", normalize_money(F.col("price_text"), 18, 2))


@query(f"""SELECT *, CAST(incurred + pending AS DECIMAL(38,2)) AS maximum,
  CAST(all_statuses - (incurred + pending) AS DECIMAL(38,2)) AS unassigned FROM (SELECT
  CAST(SUM({CLEAN_MONEY}) FILTER (WHERE LOWER(TRIM(status_raw)) IN ('f', 'o'))
    AS DECIMAL(38,2)) AS incurred,
  CAST(SUM({CLEAN_MONEY}) FILTER (WHERE LOWER(TRIM(status_raw)) = 'p') AS DECIMAL(38,2)) AS pending,
  CAST(SUM({CLEAN_MONEY}) AS DECIMAL(38,2)) AS all_statuses FROM O)""", "O")
def exposure_summary_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.exposure_summary(
        orders_view(spark, sf_dir), "status_raw", normalize_money(F.col("price_text"), 18, 2),
        incurred=["f", "o"], pending=["p"])


@query("""SELECT o_orderkey, o_custkey, status_raw FROM O WHERE o_orderkey % 3 = 0 AND o_orderkey < 1200""", "O")
def lookup_rows_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four hundred listed keys."""
    return referential.lookup_rows(
        orders_view(spark, sf_dir), "o_orderkey", range(0, 1200, 3), ["o_orderkey", "o_custkey", "status_raw"])
