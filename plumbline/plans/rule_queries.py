"""Business rules and date checks on the test tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.parsing import parse_date_fallback, parse_ymd
from plumbline.operators import dates, rules
from plumbline.plans.registry import query
from plumbline.plans.tables import table
from plumbline.plans.views import (
    COMBINED_SQL,
    COMPONENT_SQL,
    combined_formula,
    component_formula,
    lines_view,
    orders_view,
    shipments_view,
)

# Fixed value: the reporting cutoff applied to the order and shipping dates.
CUTOFF = dt.date(2001, 6, 30)
CUTOFF_SQL = f"DATE '{CUTOFF}'"


def _combined():
    return combined_formula(F.col("price"), F.col("disc"), F.col("tax"))


def _component():
    return component_formula(F.col("price"), F.col("disc"), F.col("tax"))

@query("SELECT * FROM S WHERE order_date > ship_date", "S")
def order_violations_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.order_violations(
        shipments_view(spark, sf_dir), F.col("order_date"), F.col("ship_date"))


@query("""SELECT l_orderkey, l_linenumber, price, recorded FROM L WHERE recorded > price""", "L")
def order_violations_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_view(spark, sf_dir).select("l_orderkey", "l_linenumber", "price", "recorded")
    return rules.order_violations(rows, F.col("recorded"), F.col("price"))


NET_SQL = "CAST(round(price * (CAST(1 AS DECIMAL(4,2)) - disc), 2) AS DECIMAL(18,2))"
LEVY_SQL = f"CAST(round({NET_SQL} * tax, 2) AS DECIMAL(18,2))"


def _net_and_levy(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1).cast("decimal(4,2)")
    net = F.round(F.col("price") * (one - F.col("disc")), 2).cast("decimal(18,2)")
    rows = lines_view(spark, sf_dir).withColumn("net", net)
    levy = F.round(F.col("net") * F.col("tax"), 2).cast("decimal(18,2)")
    return rows.withColumn("levy", levy).select(
        "l_orderkey", "l_linenumber", "net", "levy", "recorded")


@query(f"""SELECT *, CAST(net + levy AS DECIMAL(19,2)) AS calculated_total,
  CAST(recorded - (net + levy) AS DECIMAL(20,2)) AS variance
  FROM (SELECT l_orderkey, l_linenumber, {NET_SQL} AS net, {LEVY_SQL} AS levy, recorded FROM L)
  WHERE net + levy <> recorded""", "L")
def sum_rule_mismatches_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.sum_rule_mismatches(
        _net_and_levy(spark, sf_dir), ["net", "levy"], "recorded")
    return found.withColumn("variance", F.col("variance").cast("decimal(20,2)"))


@query(f"""SELECT *, matching + mismatching + untestable AS classified,
  matching + mismatching + untestable = total_rows AS reconciles FROM (SELECT
  COUNT(*) FILTER (WHERE {COMBINED_SQL} = recorded) AS matching,
  COUNT(*) FILTER (WHERE {COMBINED_SQL} <> recorded) AS mismatching,
  COUNT(*) FILTER (WHERE {COMBINED_SQL} IS NULL OR recorded IS NULL) AS untestable,
  COUNT(*) AS total_rows FROM L)""", "L")
def rule_reconciliation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_reconciliation(lines_view(spark, sf_dir), _combined(), F.col("recorded"))


@query(f"""SELECT CAST(recorded - {COMBINED_SQL} AS DECIMAL(20,2)) AS difference,
  COUNT(*) AS row_count FROM L WHERE {COMBINED_SQL} <> recorded GROUP BY 1""", "L")
def mismatch_histogram_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.mismatch_histogram(lines_view(spark, sf_dir), _combined(), F.col("recorded"))
    return found.withColumn("difference", F.col("difference").cast("decimal(20,2)"))


@query(f"""SELECT *, {COMBINED_SQL} AS expected FROM L WHERE recorded - {COMBINED_SQL} = 125""",
       "L")
def mismatch_rows_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.mismatch_rows(
        lines_view(spark, sf_dir), _combined(), F.col("recorded"), Decimal("125.00"))


@query(f"""SELECT COUNT(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS testable,
  COUNT(*) FILTER (WHERE a = recorded AND b = recorded) AS "both",
  COUNT(*) FILTER (WHERE a = recorded AND b <> recorded) AS first_only,
  COUNT(*) FILTER (WHERE a <> recorded AND b = recorded) AS second_only,
  COUNT(*) FILTER (WHERE a <> recorded AND b <> recorded) AS neither
  FROM (SELECT {COMBINED_SQL} AS a, {COMPONENT_SQL} AS b, recorded FROM L)""", "L")
def formula_overlap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.formula_overlap(
        lines_view(spark, sf_dir), _combined(), _component(), F.col("recorded"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, recorded,
  CAST(recorded - a AS DECIMAL(20,2)) AS first_difference,
  CAST(recorded - b AS DECIMAL(20,2)) AS second_difference,
  CASE WHEN b = recorded THEN 'second_only' ELSE 'neither' END AS outcome
  FROM (SELECT *, {COMBINED_SQL} AS a, {COMPONENT_SQL} AS b FROM L) WHERE a <> recorded""", "L")
def formula_outcome_rows_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.formula_outcome_rows(
        lines_view(spark, sf_dir), _combined(), _component(), F.col("recorded"),
        ["second_only", "neither"])
    return found.select(
        "l_orderkey", "l_linenumber", "l_partkey", "recorded",
        F.col("first_difference").cast("decimal(20,2)").alias("first_difference"),
        F.col("second_difference").cast("decimal(20,2)").alias("second_difference"),
        "outcome")


IMPLIED_SQL = """CAST(round(1 - CAST(recorded AS DOUBLE)
  / CAST(price * (CAST(1 AS DECIMAL(4,2)) + tax) AS DOUBLE), 2) AS DECIMAL(4,2))"""
BACK_SQL = """CAST(round(price * (CAST(1 AS DECIMAL(4,2)) - disc_candidate)
  * (CAST(1 AS DECIMAL(4,2)) + tax), 2) AS DECIMAL(18,2)) = recorded"""


@query(f"""SELECT *, disc_candidate IS NOT NULL AS disc_inferred,
  CASE WHEN disc_candidate IS NOT NULL THEN {BACK_SQL} END AS disc_confirmed
  FROM (SELECT *, CASE WHEN disc IS NULL THEN {IMPLIED_SQL} END AS disc_candidate FROM L)""", "L")
def derive_missing_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discount the recorded amount implies, put back into the formula as a check."""
    gross = F.col("price") * (F.lit(1).cast("decimal(4,2)") + F.col("tax"))
    implied = F.round(1 - F.col("recorded") / gross, 2).cast("decimal(4,2)")
    return rules.derive_missing(
        lines_view(spark, sf_dir), "disc", implied,
        lambda c: combined_formula(F.col("price"), c, F.col("tax")) == F.col("recorded"))


@query("""SELECT l.* EXCLUDE (disc, rid), 11::BIGINT AS candidates_tried,
  COUNT(*) OVER (PARTITION BY l.rid) AS matching_candidates, g.candidate
  FROM (SELECT *, row_number() OVER () AS rid FROM L WHERE disc IS NULL) l,
  (SELECT CAST(i / 100.0 AS DECIMAL(4,2)) AS candidate FROM range(0, 11) t(i)) g
  WHERE CAST(round(l.price * (CAST(1 AS DECIMAL(4,2)) - g.candidate)
    * (CAST(1 AS DECIMAL(4,2)) + l.tax), 2) AS DECIMAL(18,2)) = l.recorded""", "L")
def candidate_search_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All discounts from 0.00 to 0.10 that reproduce the recorded amount of a line without one."""
    targets = lines_view(spark, sf_dir).filter(F.col("disc").isNull()).drop("disc")
    return rules.candidate_search(
        targets, 0, 10, 2,
        lambda c: combined_formula(F.col("price"), c, F.col("tax")), F.col("recorded"),
    ).withColumn("candidate", F.col("candidate").cast("decimal(4,2)"))


@query("""SELECT user_id, event_type, MIN(report_date) AS first_date, MAX(report_date) AS last_date,
  COUNT(*) AS row_count FROM (SELECT *, CAST(ts AS DATE) AS report_date FROM events)
  GROUP BY 1, 2""")
def attribute_history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_type", F.col("ts").cast("date").alias("report_date"))
    return rules.attribute_history(rows, "user_id", "event_type", "report_date")


def _date_range_sql(table: str, columns: dict[str, str]) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{name}' AS column_name, COUNT(*) - COUNT({d}) AS null_count,
        MIN({d}) AS earliest, MAX({d}) AS latest,
        COUNT(*) FILTER (WHERE {d} > {CUTOFF_SQL}) AS after_cutoff FROM {table}"""
        for name, d in columns.items()
    )


@query(_date_range_sql("orders", {"o_orderdate": "CAST(o_orderdate AS DATE)"}) + "\nUNION ALL "
       + _date_range_sql("lineitem", {"l_shipdate": "CAST(l_shipdate AS DATE)"}))
def date_range_profile_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = (table(spark, sf_dir, t) for t in ("orders", "lineitem"))
    return dates.date_range_profile(
        orders, {"o_orderdate": F.col("o_orderdate").cast("date")}, CUTOFF
    ).unionAll(dates.date_range_profile(
        lines, {"l_shipdate": F.col("l_shipdate").cast("date")}, CUTOFF))


FALLBACK_SQL = """COALESCE(TRY_CAST(date_text AS DATE),
  CAST(TRY_STRPTIME(date_text, '%m/%d/%Y') AS DATE))"""


@query(_date_range_sql("O", {"direct": "TRY_CAST(date_text AS DATE)", "fallback": FALLBACK_SQL}),
       "O")
def date_range_profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("date_text")
    return dates.date_range_profile(
        orders_view(spark, sf_dir),
        {"direct": parse_ymd(text), "fallback": parse_date_fallback(text)}, CUTOFF)


@query(f"""SELECT COUNT(*) AS total_rows, COUNT(ship_date) AS populated,
  COUNT(*) FILTER (WHERE ship_date IS NULL) AS null_count,
  MIN(ship_date) AS earliest, MAX(ship_date) AS latest,
  COUNT(*) FILTER (WHERE ship_date < order_date) AS before_anchor,
  COUNT(*) FILTER (WHERE ship_date = order_date) AS on_anchor,
  COUNT(*) FILTER (WHERE ship_date > order_date) AS after_anchor,
  COUNT(*) FILTER (WHERE ship_date > {CUTOFF_SQL}) AS after_cutoff FROM S""", "S")
def date_relation_profile_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.date_relation_profile(
        shipments_view(spark, sf_dir), F.col("ship_date"), F.col("order_date"), CUTOFF)


@query("""SELECT *, date_diff('day', ship_date, order_date) AS gap_days FROM S
  WHERE ship_date < order_date""", "S")
def date_gap_rows_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.date_gap_rows(
        shipments_view(spark, sf_dir), F.col("ship_date"), F.col("order_date"))


def _timeline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as dated facts, orders as the plan: due on the order date plus 365 days."""
    facts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("date").alias("ship_date"))
    start = F.col("o_orderdate").cast("date")
    dim = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", start.alias("start_date"),
        F.date_add(start, 365).alias("due_date"))
    return facts, dim


TIMELINE_SQL = """WITH t AS (SELECT CAST(l_shipdate AS DATE) AS ship_date, start_date, due_date,
  o_orderpriority FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey, o_orderpriority,
  CAST(o_orderdate AS DATE) AS start_date,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 365 DAY AS DATE) AS due_date FROM orders)
  ON l_orderkey = o_orderkey) """


@query(TIMELINE_SQL + f"""SELECT COUNT(*) AS total_rows,
  COUNT(*) FILTER (WHERE ship_date < start_date) AS before_start,
  COUNT(*) FILTER (WHERE ship_date > due_date) AS after_due,
  COUNT(*) FILTER (WHERE ship_date > {CUTOFF_SQL}) AS after_cutoff FROM t""")
def timeline_violations_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, dim = _timeline(spark, sf_dir)
    return dates.timeline_violations(
        facts, dim, "o_orderkey", "ship_date", {"before_start": "start_date"},
        {"after_due": "due_date"}, CUTOFF)


OVERRUN_SQL = TIMELINE_SQL + """SELECT {g}, COUNT(*) AS late_rows, MIN(ship_date) AS first_late_date,
  MAX(ship_date) AS last_late_date, MAX(date_diff('day', due_date, ship_date)) AS max_days_beyond
  FROM t WHERE ship_date > due_date GROUP BY {g}"""


@query(OVERRUN_SQL.format(g="o_orderpriority"))
def overrun_by_group_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, dim = _timeline(spark, sf_dir)
    return dates.overrun_by_group(
        facts, dim, "o_orderkey", "ship_date", "due_date", ["o_orderpriority"])


@query(OVERRUN_SQL.replace("SELECT CAST(l_shipdate", "SELECT o_orderkey, CAST(l_shipdate").format(
    g="o_orderkey") + " ORDER BY late_rows DESC, o_orderkey LIMIT 10")
def overrun_by_group_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten orders with the most late lines: the limit is the report."""
    facts, dim = _timeline(spark, sf_dir)
    return dates.overrun_by_group(
        facts, dim, "o_orderkey", "ship_date", "due_date", ["o_orderkey"], k=10)


@query("""SELECT CAST(isodow(d) AS BIGINT) AS weekday_number, dayname(d) AS weekday_name,
  COUNT(*) AS entity_dates FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events)
  GROUP BY 1, 2""")
def weekday_distribution_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates.weekday_distribution(
        table(spark, sf_dir, "events"), "user_id", F.col("ts").cast("date"))


ROLLUP_TYPES = "CASE WHEN event_type = 'error' THEN NULL ELSE upper(event_type) END"


@query(f"""SELECT user_id, report_date, COUNT(*) AS row_count,
  COUNT(DISTINCT event_type) AS distinct_ids,
  array_to_string(LIST(DISTINCT event_type ORDER BY event_type), ',') AS raw_types,
  array_to_string([COALESCE(x, 'NULL') FOR x IN
    LIST(DISTINCT std_type ORDER BY std_type NULLS LAST)], ',') AS std_types,
  CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_value
  FROM (SELECT *, CAST(ts AS DATE) AS report_date, {ROLLUP_TYPES} AS std_type FROM events)
  GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def entity_date_rollup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.col("ts").cast("date").alias("report_date"), "event_type",
        F.when(kind == "error", None).otherwise(F.upper(kind)).alias("std_type"), "value")
    rollup = dates.entity_date_rollup(
        rows, "user_id", "report_date", "event_type",
        {"raw_types": "event_type", "std_types": "std_type"},
        {"total_value": F.col("value").cast("decimal(18,2)")})
    return rollup.withColumns({
        "total_value": F.col("total_value").cast("decimal(38,2)"),
        "raw_types": F.array_join("raw_types", ","),
        "std_types": F.array_join("std_types", ",", "NULL"),
    })


@query("""SELECT user_id, CAST(ts AS DATE) AS report_date, event_type, COUNT(*) AS row_count
  FROM events GROUP BY 1, 2, 3""")
def entity_date_values_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.col("ts").cast("date").alias("report_date"), "event_type")
    return dates.entity_date_values(rows, "user_id", "report_date", "event_type")


@query("""SELECT event_type, report_date, (place - 1) // 20 AS page,
  array_to_string(LIST(user_id ORDER BY place), ',') AS users FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type, report_date ORDER BY user_id) AS place FROM (
      SELECT DISTINCT event_type, CAST(ts AS DATE) AS report_date, user_id FROM events)) GROUP BY 1, 2, 3""")
def entity_date_pages_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users behind each kind of event and day, in pages of twenty."""
    rows = table(spark, sf_dir, "events").select(
        "event_type", F.col("ts").cast("date").alias("report_date"), "user_id")
    pages = dates.entity_date_pages(rows, "event_type", "report_date", "user_id", 20)
    return pages.select("event_type", "report_date", "page", F.array_join(F.col("values").cast("array<string>"), ",").alias("users"))
