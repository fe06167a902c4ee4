"""Category values, parsing and numeric profiles on the test tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import parsing as parse
from plumbline.operators import categorical, numeric, parsing, structure
from plumbline.plans.registry import query
from plumbline.plans.tables import table
from plumbline.plans.views import lines_view, orders_view, updates_view

# Standard order statuses and the day after which dates count as late.
STATUSES = {"f": "F", "o": "O", "p": "P"}
DIRECT_MONEY = "TRY_CAST(price_text AS DECIMAL(18,2))"
CLEAN_MONEY = "TRY_CAST(replace(replace(price_text, '$', ''), ',', '') AS DECIMAL(18,2))"
DIRECT_DATE = "TRY_CAST(date_text AS DATE)"
MDY_DATE = "CAST(TRY_STRPTIME(date_text, '%m/%d/%Y') AS DATE)"
CLEAN_PERCENT = "TRY_CAST(replace(pct_text, '%', '') AS DECIMAL(5,1))"


@query("""SELECT status_raw AS value, '[' || status_raw || ']' AS display, COUNT(*) AS row_count
  FROM O GROUP BY status_raw""", "O")
def value_frequency_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorical.value_frequency(orders_view(spark, sf_dir), "status_raw")


@query("""SELECT event_type AS value, '[' || event_type || ']' AS display, COUNT(*) AS row_count
  FROM events WHERE value > 10 GROUP BY event_type""")
def value_frequency_large_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorical.value_frequency(
        table(spark, sf_dir, "events"), "event_type", F.col("value") > 10)


@query("""SELECT source AS value, '[' || source || ']' AS display, COUNT(*) AS row_count
  FROM documents GROUP BY source""")
def value_frequency_document_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorical.value_frequency(table(spark, sf_dir, "documents"), "source")


@query("""SELECT * FROM O WHERE (LOWER(TRIM(status_raw)) IN ('f', 'o', 'p')
  AND status_raw NOT IN ('F', 'O', 'P')) OR status_raw = '  '""", "O")
def variant_rows_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorical.variant_rows(
        orders_view(spark, sf_dir), "status_raw", ["F", "O", "P"], watch=["  "])


@query("""SELECT status_raw, std_status, COUNT(*) AS row_count, std_status IS NOT NULL AS is_mapped
  FROM (SELECT status_raw, CASE LOWER(TRIM(status_raw)) WHEN 'f' THEN 'F' WHEN 'o' THEN 'O'
        WHEN 'p' THEN 'P' END AS std_status FROM O) GROUP BY 1, 2""", "O")
def standardize_map_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = categorical.standardize_map(
        orders_view(spark, sf_dir), "status_raw", STATUSES, "std_status")
    return categorical.mapping_report(rows, "status_raw", "std_status")


@query("""SELECT p_partkey, p_type, lower(split_part(p_type, ' ', 1)) AS std_type FROM part""")
def standardize_map_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping table derived from the data instead of a literal list."""
    part = table(spark, sf_dir, "part")
    mapping = part.select(F.lower(F.trim("p_type")).alias("value")).distinct().withColumn(
        "standard", F.split_part("value", F.lit(" "), F.lit(1)))
    mapped = categorical.standardize_map(part, "p_type", mapping, "std_type")
    return mapped.select("p_partkey", "p_type", "std_type")


# Corrections for two orders whose customer is recorded under an unknown key.
ORDER_FIXES = {307: 1, 614: 2}


@query("""SELECT *, CASE o_orderkey WHEN 307 THEN 1 WHEN 614 THEN 2 ELSE o_custkey END
  AS std_custkey, o_orderkey IN (307, 614) AS std_custkey_corrected FROM O""", "O")
def keyed_correction_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorical.keyed_correction(
        orders_view(spark, sf_dir), "o_orderkey", "o_custkey", ORDER_FIXES, "std_custkey")


@query("""SELECT b.*, COALESCE(o.o_custkey, b.o_custkey) AS std_custkey,
  o.o_custkey IS NOT NULL AS std_custkey_corrected
  FROM O b LEFT JOIN orders o ON b.o_orderkey = o.o_orderkey""", "O")
def keyed_correction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections as a table: the order master overrides the defective export."""
    fixes = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value"))
    return categorical.keyed_correction(
        orders_view(spark, sf_dir), "o_orderkey", "o_custkey", fixes, "std_custkey")


@query("""SELECT status_raw AS value, COUNT(*) AS row_count,
  regexp_full_match(status_raw, '^[FOP]$') AS matches_format FROM O GROUP BY status_raw""", "O")
def format_check_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorical.format_check(orders_view(spark, sf_dir), "status_raw", "[FOP]")


@query(f"""SELECT *, {DIRECT_MONEY} AS parsed FROM O
  WHERE price_text IS NOT NULL AND {DIRECT_MONEY} IS NULL""", "O")
def parse_failures_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    direct = parse.to_decimal(F.col("price_text"), 18, 2)
    return parsing.parse_failures(orders_view(spark, sf_dir), "price_text", direct, "parsed")


@query(f"""SELECT *, {DIRECT_DATE} AS parsed FROM O
  WHERE date_text IS NOT NULL AND {DIRECT_DATE} IS NULL""", "O")
def parse_failures_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    direct = parse.parse_ymd(F.col("date_text"))
    return parsing.parse_failures(orders_view(spark, sf_dir), "date_text", direct, "parsed")


@query(f"""SELECT date_text AS value, COUNT(*) AS row_count FROM O
  WHERE date_text IS NOT NULL AND {DIRECT_DATE} IS NULL GROUP BY 1""", "O")
def parse_failure_values_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_failure_values(
        orders_view(spark, sf_dir), "date_text", parse.parse_ymd(F.col("date_text")))


@query(f"""SELECT date_text AS value, COUNT(*) AS row_count FROM O
  WHERE date_text IS NOT NULL AND COALESCE({DIRECT_DATE}, {MDY_DATE}) IS NULL GROUP BY 1""", "O")
def parse_failure_values_after_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_failure_values(
        orders_view(spark, sf_dir), "date_text", parse.parse_date_fallback(F.col("date_text")))


@query(f"""SELECT COUNT(*) AS total_rows, COUNT(date_text) AS populated,
  COUNT({DIRECT_DATE}) AS direct,
  COUNT(*) FILTER (WHERE {DIRECT_DATE} IS NULL AND {MDY_DATE} IS NOT NULL) AS fallback,
  COUNT(*) FILTER (WHERE date_text IS NOT NULL AND COALESCE({DIRECT_DATE}, {MDY_DATE}) IS NULL)
  AS failed_all FROM O""", "O")
def parse_profile_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("date_text")
    return parsing.parse_profile(
        orders_view(spark, sf_dir), "date_text",
        {"direct": parse.parse_ymd(text), "fallback": parse.parse_mdy(text)})


@query(f"""SELECT COUNT(*) AS total_rows, COUNT(pct_text) AS populated,
  COUNT(TRY_CAST(pct_text AS DECIMAL(5,1))) AS direct,
  COUNT(*) FILTER (WHERE TRY_CAST(pct_text AS DECIMAL(5,1)) IS NULL
                   AND {CLEAN_PERCENT} IS NOT NULL) AS without_sign,
  COUNT(*) FILTER (WHERE pct_text IS NOT NULL AND {CLEAN_PERCENT} IS NULL) AS failed_all
  FROM U""", "U")
def parse_profile_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("pct_text")
    stages = {"direct": parse.to_decimal(text, 5, 1),
              "without_sign": parse.normalize_percent(text, 5, 1)}
    return parsing.parse_profile(updates_view(spark, sf_dir), "pct_text", stages)


@query(f"""SELECT o_orderkey, price_text, {CLEAN_MONEY} AS price,
  {DIRECT_MONEY} IS NULL AS was_formatted FROM O""", "O")
def normalize_money_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("price_text")
    return orders_view(spark, sf_dir).select(
        "o_orderkey", "price_text", parse.normalize_money(text, 18, 2).alias("price"),
        parse.to_decimal(text, 18, 2).isNull().alias("was_formatted"))


@query(f"""SELECT event_id, pct_text, {CLEAN_PERCENT} AS pct,
  strpos(pct_text, '%') > 0 AS had_sign FROM U""", "U")
def normalize_percent_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("pct_text")
    return updates_view(spark, sf_dir).select(
        "event_id", "pct_text", parse.normalize_percent(text, 5, 1).alias("pct"),
        parse.has_percent_sign(text).alias("had_sign"))


@query(f"""SELECT *, {MDY_DATE} AS std_date FROM O
  WHERE {DIRECT_DATE} IS NULL AND {MDY_DATE} IS NOT NULL""", "O")
def fallback_date_rows_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.fallback_date_rows(orders_view(spark, sf_dir), "date_text", "std_date")


MIDNIGHT_SQL = """SELECT COUNT(*) AS total_rows, COUNT({c}) AS populated,
  COUNT(*) FILTER (WHERE CAST({c} AS TIME) = TIME '00:00:00') AS at_midnight,
  COUNT(*) FILTER (WHERE CAST({c} AS TIME) <> TIME '00:00:00') AS with_time FROM {t}"""


@query(MIDNIGHT_SQL.format(c="o_orderdate", t="orders"))
def midnight_check_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.midnight_check(table(spark, sf_dir, "orders"), "o_orderdate")


@query(MIDNIGHT_SQL.format(c="ts", t="events"))
def midnight_check_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.midnight_check(table(spark, sf_dir, "events"), "ts")


def _range_sql(table: str, columns: list[str], low: str, high: str, kind: str = "DECIMAL(38,6)") -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT(*) AS total_rows, COUNT({c}) AS testable,
        CAST(MIN({c}) AS {kind}) AS minimum, CAST(MAX({c}) AS {kind}) AS maximum,
        COUNT(*) FILTER (WHERE {c} = 0) AS zero_count,
        COUNT(*) FILTER (WHERE {c} < 0) AS negative_count,
        COUNT(*) FILTER (WHERE isnan(CAST({c} AS DOUBLE))) AS nan_count,
        COUNT(*) FILTER (WHERE isinf(CAST({c} AS DOUBLE))) AS infinite_count,
        COUNT(*) FILTER (WHERE {c} < {low}) AS below_low_count,
        COUNT(*) FILTER (WHERE {c} = {low}) AS at_low_count,
        COUNT(*) FILTER (WHERE {c} > {high}) AS above_high_count,
        COUNT(*) FILTER (WHERE {c} = {high}) AS at_high_count FROM {table}"""
        for c in columns
    )


@query(_range_sql("customer", ["c_acctbal"], "0", "9000", "DOUBLE"))
def range_profile_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.range_profile(table(spark, sf_dir, "customer"), ["c_acctbal"], 0, 9000)


@query(_range_sql("U", ["planned_pct", "actual_pct"], "0", "100"), "U")
def range_profile_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.range_profile(
        updates_view(spark, sf_dir), ["planned_pct", "actual_pct"], 0, 100)


def _fraction_sql(table: str, columns: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count,
        COUNT(*) FILTER (WHERE {c} <> TRUNC({c})) AS fractional_count,
        CAST(MIN({c}) AS DOUBLE) AS minimum, CAST(MAX({c}) AS DOUBLE) AS maximum
        FROM {table}"""
        for c in columns
    )


FRACTION_COLUMNS = ["l_quantity", "l_discount", "l_extendedprice"]


@query(_fraction_sql("lineitem", FRACTION_COLUMNS))
def fractional_profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.fractional_profile(table(spark, sf_dir, "lineitem"), FRACTION_COLUMNS)


def _scale_sql(table: str, column: str) -> str:
    changed = {s: f"COUNT(*) FILTER (WHERE {column} <> CAST({column} AS DECIMAL(28,{s})))"
               for s in range(5)}
    counts = ", ".join(f"{c} AS changed_at_{s}" for s, c in changed.items())
    smallest = " ".join(f"WHEN changed_at_{s} = 0 THEN {s}" for s in changed)
    return f"""SELECT *, CAST(CASE {smallest} END AS BIGINT) AS lossless_scale FROM
      (SELECT COUNT(*) AS total_rows, COUNT({column}) AS testable, {counts} FROM {table})"""


@query(_scale_sql("(SELECT CAST(l_discount AS DECIMAL(18,6)) AS d FROM lineitem)", "d"))
def scale_loss_profile_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_discount").cast("decimal(18,6)").alias("d"))
    return numeric.scale_loss_profile(rows, "d")


@query(_scale_sql("U", "actual_pct"), "U")
def scale_loss_profile_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.scale_loss_profile(updates_view(spark, sf_dir), "actual_pct")


@query(f"""WITH m AS (SELECT 'price' AS column_name, MAX(ABS({CLEAN_MONEY})) AS v FROM O
  UNION ALL SELECT 'balance', MAX(ABS(CAST(c_acctbal AS DECIMAL(18,2)))) FROM customer)
  SELECT column_name, CAST(v AS DECIMAL(38,6)) AS max_abs,
  CASE WHEN v < 1 THEN 0 ELSE length(CAST(CAST(floor(v) AS BIGINT) AS VARCHAR)) END::BIGINT
  AS integer_digits FROM m""", "O")
def precision_profile_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = {"price": parse.normalize_money(F.col("price_text"), 18, 2)}
    balance = {"balance": F.col("c_acctbal").cast("decimal(18,2)")}
    return numeric.precision_profile(orders_view(spark, sf_dir), price).unionAll(
        numeric.precision_profile(table(spark, sf_dir, "customer"), balance))


@query("""WITH b AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi,
  MIN(l_quantity) AS qlo, MAX(l_quantity) AS qhi FROM lineitem)
  SELECT l.*, 'minimum l_extendedprice' AS extreme FROM lineitem l, b WHERE l_extendedprice = lo
  UNION ALL SELECT l.*, 'maximum l_extendedprice' FROM lineitem l, b WHERE l_extendedprice = hi
  UNION ALL SELECT l.*, 'minimum l_quantity' FROM lineitem l, b WHERE l_quantity = qlo
  UNION ALL SELECT l.*, 'maximum l_quantity' FROM lineitem l, b WHERE l_quantity = qhi""")
def extreme_rows_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.extreme_rows(
        table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"])


@query("""WITH v AS (SELECT event_id, user_id, report_date, actual_pct - planned_pct AS variance
  FROM U), b AS (SELECT MIN(variance) AS lo, MAX(variance) AS hi FROM v)
  SELECT v.*, 'minimum variance' AS extreme FROM v, b WHERE variance = lo
  UNION ALL SELECT v.*, 'maximum variance' FROM v, b WHERE variance = hi""", "U")
def extreme_rows_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    variance = (F.col("actual_pct") - F.col("planned_pct")).alias("variance")
    rows = updates_view(spark, sf_dir, written=True).select(
        "event_id", "user_id", "report_date", variance)
    return numeric.extreme_rows(rows, ["variance"])


@query("""SELECT c_custkey, c_name, c_acctbal, CAST(c_acctbal AS DECIMAL(18,2)) AS balance
  FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) < 0""")
def out_of_range_rows_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return numeric.out_of_range_rows(
        rows, F.col("c_acctbal").cast("decimal(18,2)"), "balance", low=Decimal(0))


@query(f"""SELECT event_id, pct_text, {CLEAN_PERCENT} AS pct FROM U
  WHERE {CLEAN_PERCENT} < 0 OR {CLEAN_PERCENT} > 100""", "U")
def out_of_range_rows_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = updates_view(spark, sf_dir).select("event_id", "pct_text")
    return numeric.out_of_range_rows(
        rows, parse.normalize_percent(F.col("pct_text"), 5, 1), "pct", low=0, high=100)


@query("""SELECT *, no_tax + taxed = over_threshold AS reconciles FROM (SELECT
  COUNT(*) FILTER (WHERE l_quantity > 40) AS over_threshold,
  COUNT(*) FILTER (WHERE l_quantity > 40 AND l_tax = 0) AS no_tax,
  COUNT(*) FILTER (WHERE l_quantity > 40 AND l_tax > 0) AS taxed FROM lineitem)""")
def threshold_crosstab_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.threshold_crosstab(
        table(spark, sf_dir, "lineitem"), F.col("l_quantity") > 40,
        {"no_tax": F.col("l_tax") == 0, "taxed": F.col("l_tax") > 0})


@query(_range_sql("L", ["price", "disc", "tax", "recorded"], "0", "100000"), "L")
def range_profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.range_profile(
        lines_view(spark, sf_dir), ["price", "disc", "tax", "recorded"], 0, 100000)


@query("""SELECT 'VARCHAR' AS inferred_type, COUNT(*) AS total_rows, COUNT(date_text) AS populated,
  COUNT(TRY_CAST(date_text AS DATE)) AS parsed,
  COUNT(*) FILTER (WHERE date_text IS NOT NULL AND TRY_CAST(date_text AS DATE) IS NULL) AS failed FROM O""", "O")
def type_parse_counts_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many date texts are full dates."""
    return structure.type_parse_counts(orders_view(spark, sf_dir), "date_text", "date")


MANY_FIXES = {key: key + 7 for key in range(4, 2004, 4)}


@query("""SELECT *, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey BETWEEN 4 AND 2003 THEN o_orderkey + 7 ELSE o_custkey END
    AS std_custkey, COALESCE(o_orderkey % 4 = 0 AND o_orderkey BETWEEN 4 AND 2003, FALSE) AS std_custkey_corrected
  FROM O""", "O")
def keyed_correction_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred listed fixes."""
    return categorical.keyed_correction(
        orders_view(spark, sf_dir), "o_orderkey", "o_custkey",
        {k: v for k, v in MANY_FIXES.items()}, "std_custkey").withColumn(
        "std_custkey", F.col("std_custkey").cast("bigint"))
