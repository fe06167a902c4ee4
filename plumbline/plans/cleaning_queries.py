"""Cleaned tables over the defect views, and the remaining checks between the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import parsing as parse
from plumbline.functions.text import folded, mapped
from plumbline.operators import categorical, keys, numeric, referential
from plumbline.operators.cleaning import CleaningPlan, apply_plan, clean, flag_counts
from plumbline.operators.ordering import with_neighbors
from plumbline.plans.profile_queries import KEY_PROFILE_SQL
from plumbline.plans.registry import query
from plumbline.plans.rule_queries import IMPLIED_SQL
from plumbline.plans.tables import table
from plumbline.plans.value_queries import (
    CLEAN_MONEY,
    CLEAN_PERCENT,
    DIRECT_DATE,
    DIRECT_MONEY,
    MDY_DATE,
    ORDER_FIXES,
    STATUSES,
)
from plumbline.plans.views import (
    COMBINED_SQL,
    combined_formula,
    lines_view,
    orders_view,
    updates_view,
)
from plumbline.sources.tables import shared_folder, write_cleaned


def flags_sql(flags: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in flags.items())
    return f"[x for x in [{cases}] if x IS NOT NULL]"


def flags_as_text(cleaned: DataFrame) -> DataFrame:
    """Flag list as one text value, the form in which results are compared."""
    return cleaned.withColumn("flags", F.array_join("flags", ","))


def text_sql(query_sql: str) -> str:
    return f"SELECT * REPLACE (array_to_string(flags, ',') AS flags) FROM ({query_sql})"


STD_STATUS_SQL = """CASE LOWER(TRIM(status_raw)) WHEN 'f' THEN 'F' WHEN 'o' THEN 'O'
  WHEN 'p' THEN 'P' END"""
ORDER_FLAGS_SQL = flags_sql({
    "customer_corrected": "o_orderkey IN (307, 614)",
    "customer_missing": "std_custkey IS NULL",
    "status_standardized": "status_raw <> std_status",
    "status_unknown": "std_status IS NULL",
    "price_reformatted": f"std_price IS NOT NULL AND {DIRECT_MONEY} IS NULL",
    "date_fallback": f"{DIRECT_DATE} IS NULL AND {MDY_DATE} IS NOT NULL",
    "date_unparsed": "date_text IS NOT NULL AND std_date IS NULL",
})
CLEAN_ORDERS_SQL = f"""SELECT *, {ORDER_FLAGS_SQL} AS flags FROM (SELECT DISTINCT O.*,
  CASE o_orderkey WHEN 307 THEN 1 WHEN 614 THEN 2 ELSE o_custkey END AS std_custkey,
  {STD_STATUS_SQL} AS std_status, {CLEAN_MONEY} AS std_price,
  COALESCE({DIRECT_DATE}, {MDY_DATE}) AS std_date FROM O)"""


def orders_plan() -> CleaningPlan:
    status, price, date = F.col("status_raw"), F.col("price_text"), F.col("date_text")
    std_status = mapped(folded(status), STATUSES)
    fix = mapped(F.col("o_orderkey"), ORDER_FIXES)
    return CleaningPlan(
        key="o_orderkey",
        standard={
            "std_custkey": F.coalesce(fix, F.col("o_custkey")),
            "std_status": std_status,
            "std_price": parse.normalize_money(price, 18, 2),
            "std_date": parse.parse_date_fallback(date),
        },
        flags={
            "customer_corrected": fix.isNotNull(),
            "customer_missing": F.col("std_custkey").isNull(),
            "status_standardized": status != std_status,
            "status_unknown": std_status.isNull(),
            "price_reformatted":
                F.col("std_price").isNotNull() & parse.to_decimal(price, 18, 2).isNull(),
            "date_fallback": parse.needed_fallback(date),
            "date_unparsed": date.isNotNull() & F.col("std_date").isNull(),
        },
    )


@query(text_sql(CLEAN_ORDERS_SQL), "O")
def cleaned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags_as_text(clean(orders_view(spark, sf_dir), orders_plan()))


@query(text_sql(CLEAN_ORDERS_SQL), "O")
def cleaned_orders_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned table written to Parquet by status and read back."""
    cleaned = clean(orders_view(spark, sf_dir), orders_plan())
    path = shared_folder(spark, "cleaned-orders")
    written = write_cleaned(cleaned, path, [sf_dir], partition_by=["std_status"])
    return flags_as_text(written.select(*cleaned.columns))


@query(f"""SELECT flag, COUNT(*) AS row_count FROM (SELECT UNNEST(flags) AS flag
  FROM ({CLEAN_ORDERS_SQL})) GROUP BY flag""", "O")
def flag_counts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_counts(clean(orders_view(spark, sf_dir), orders_plan()))


EXPOSURE_SQL = f"""SELECT std_status, COUNT(*) AS row_count,
  CAST(SUM(std_price) AS DECIMAL(38,2)) AS net_amount FROM ({CLEAN_ORDERS_SQL}) GROUP BY 1"""


@query(EXPOSURE_SQL, "O")
def cleaned_exposure_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure on cleaned rows: each order counted once, unlike the raw export."""
    cleaned = clean(orders_view(spark, sf_dir), orders_plan())
    return cleaned.groupBy("std_status").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("std_price").cast("decimal(38,2)").alias("net_amount"))


def lines_plan() -> CleaningPlan:
    price, tax, recorded = F.col("price"), F.col("tax"), F.col("recorded")
    gross = price * (F.lit(1).cast("decimal(4,2)") + tax)
    implied = F.round(1 - recorded / gross, 2).cast("decimal(4,2)")
    usable = F.when(combined_formula(price, implied, tax) == recorded, implied)
    cent = F.lit(0.01).cast("decimal(3,2)")
    return CleaningPlan(
        key=None,
        standard={"std_disc": F.coalesce(F.col("disc"), usable)},
        derived={"difference": (
            recorded - combined_formula(price, F.col("std_disc"), tax)).cast("decimal(20,2)")},
        flags={
            "discount_inferred": F.col("disc").isNull() & F.col("std_disc").isNotNull(),
            "discount_missing": F.col("std_disc").isNull(),
            "off_by_one_cent": F.abs("difference") == cent,
            "amount_unexplained": F.abs("difference") > cent,
        },
    )


LINE_FLAGS_SQL = flags_sql({
    "discount_inferred": "disc IS NULL AND std_disc IS NOT NULL",
    "discount_missing": "std_disc IS NULL",
    "off_by_one_cent": "ABS(difference) = 0.01",
    "amount_unexplained": "ABS(difference) > 0.01",
})
WITH_CANDIDATE = COMBINED_SQL.replace("disc", "candidate")
WITH_STANDARD = COMBINED_SQL.replace("disc", "std_disc")


@query(text_sql(f"""SELECT *, {LINE_FLAGS_SQL} AS flags FROM (
  SELECT *, CAST(recorded - {WITH_STANDARD} AS DECIMAL(20,2)) AS difference FROM (
  SELECT * EXCLUDE (candidate), COALESCE(disc, CASE WHEN {WITH_CANDIDATE} = recorded
    THEN candidate END) AS std_disc
  FROM (SELECT DISTINCT L.*, {IMPLIED_SQL} AS candidate FROM L)))"""), "L")
def cleaned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags_as_text(clean(lines_view(spark, sf_dir), lines_plan()))


UPDATE_FLAGS_SQL = flags_sql({
    "percent_sign": "strpos(pct_text, '%') > 0",
    "actual_above_100": "std_actual_pct > 100",
    "actual_decreased": "std_actual_pct < previous_actual_pct",
    "behind_plan": "std_actual_pct < planned_pct",
})


@query(text_sql(f"""SELECT *, {UPDATE_FLAGS_SQL} AS flags FROM (SELECT *, LAG(std_actual_pct)
  OVER (PARTITION BY user_id ORDER BY report_date, event_id) AS previous_actual_pct
  FROM (SELECT event_id, user_id, report_date, planned_pct, pct_text,
        {CLEAN_PERCENT} AS std_actual_pct FROM U))"""), "U")
def cleaned_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, actual = F.col("pct_text"), F.col("std_actual_pct")
    rows = updates_view(spark, sf_dir, written=True).select(
        "event_id", "user_id", "report_date", "planned_pct", "pct_text")
    parsed = keys.dedup_exact(rows).withColumn(
        "std_actual_pct", parse.normalize_percent(text, 5, 1))
    linked = with_neighbors(
        parsed, ["report_date", "event_id"], {"previous_actual_pct": "std_actual_pct"},
        by=["user_id"])
    flags = {
        "percent_sign": parse.has_percent_sign(text),
        "actual_above_100": actual > 100,
        "actual_decreased": actual < F.col("previous_actual_pct"),
        "behind_plan": actual < F.col("planned_pct"),
    }
    plan = CleaningPlan(key="event_id", standard={}, flags=flags)
    return flags_as_text(apply_plan(linked, plan))


# The remaining checks: the same operators with other tables as arguments.


@query(KEY_PROFILE_SQL.format(
    k="text", t="documents", blank="COUNT(*) FILTER (WHERE TRIM(text) = '')"))
def key_profile_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as a candidate key: repeats show as surplus rows."""
    return keys.key_profile(table(spark, sf_dir, "documents").select("text"), "text", long_text=True)


@query("""SELECT conv_id, turn, COUNT(*) AS occurrences FROM conversations
  GROUP BY conv_id, turn HAVING COUNT(*) > 1""")
def duplicate_keys_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.duplicate_keys(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


@query("""SELECT role AS value, COUNT(*) AS row_count,
  regexp_full_match(role, 'user|assistant') AS matches_format FROM conversations GROUP BY role""")
def format_check_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorical.format_check(
        table(spark, sf_dir, "conversations"), "role", "user|assistant")


@query("""SELECT labels.doc_id, COUNT(*) AS row_count FROM labels
  LEFT JOIN documents ON labels.doc_id = documents.doc_id WHERE documents.doc_id IS NULL
  GROUP BY labels.doc_id""")
def orphan_counts_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referential.orphan_counts(
        table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id")


@query("""SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def orphan_keys_unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referential.orphan_keys(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT COUNT(*) AS fact_rows, COUNT(p_partkey) AS matched_rows,
  COUNT(*) - COUNT(p_partkey) AS unmatched_rows
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def enrich_report_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    return referential.enrich_report(table(spark, sf_dir, "lineitem"), parts, "l_partkey")


@query("""SELECT column_name, CAST(v AS DOUBLE) AS max_abs,
  length(CAST(CAST(floor(v) AS BIGINT) AS VARCHAR))::BIGINT AS integer_digits FROM (
  SELECT 'l_extendedprice' AS column_name, MAX(ABS(l_extendedprice)) AS v FROM lineitem
  UNION ALL SELECT 'l_quantity', MAX(ABS(l_quantity)) FROM lineitem)""")
def precision_profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numeric.precision_profile(
        table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"])
