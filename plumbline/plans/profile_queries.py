"""Structure, keys, duplicates and completeness on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import completeness, keys, structure
from plumbline.plans.registry import query
from plumbline.plans.tables import table
from plumbline.plans.views import orders_view, updates_view
from plumbline.sources.tables import csv_ingest, ingest_account, read_table, shared_folder

LINEITEM_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()
EVENT_COLUMNS = "event_id ts user_id event_type value props".split()
CUSTOMER_TEXT = ["c_name", "c_mktsegment"]
O_COLUMNS = ["o_orderkey", "o_custkey", "price_text", "date_text", "status_raw"]
O_TEXT = ["price_text", "date_text", "status_raw"]


def _per_column(columns: list[str], measure: str, source: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) AS total_rows, {measure.format(c=c)} FROM {source}"
        for c in columns
    )


def _schema_sql(table: str, columns: list[str]) -> str:
    counts = ", ".join(f"COUNT({c}) AS {c}" for c in columns)
    places = "\nUNION ALL ".join(
        f"SELECT {i + 1}::BIGINT AS position, '{c}' AS column_name" for i, c in enumerate(columns)
    )
    return f"""WITH place AS ({places}),
    total AS (SELECT COUNT(*) AS total_rows FROM {table}),
    filled AS (UNPIVOT (SELECT {counts} FROM {table}) ON {", ".join(columns)}
               INTO NAME column_name VALUE populated)
    SELECT p.position, d.column_name, d.column_type, f.populated, t.total_rows
    FROM (DESCRIBE SELECT * FROM {table}) d JOIN place p USING (column_name)
    JOIN filled f USING (column_name) JOIN total t ON TRUE"""


CSV_SCHEMA = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice decimal(18,2), "
    "o_orderdate date, o_orderpriority string"
)


def _orders_csv(spark: SparkSession, sf_dir: str) -> str:
    """The orders table as a CSV export in shared storage."""
    path = shared_folder(spark, "orders-csv")
    rows = table(spark, sf_dir, "orders").withColumns({
        "o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"),
        "o_orderdate": F.col("o_orderdate").cast("date"),
    })
    # The writer would otherwise trim outer spaces.
    rows.write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return path


@query("""SELECT o_orderkey, o_custkey, o_orderstatus,
  CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
  o_orderpriority FROM orders""")
def csv_ingest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_ingest(spark, _orders_csv(spark, sf_dir), CSV_SCHEMA)


@query("""SELECT COUNT(*) AS row_count, COUNT(DISTINCT o_orderkey) AS orders,
  MIN(CAST(o_orderdate AS DATE)) AS first_date,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM orders""")
def csv_ingest_inferred_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = csv_ingest(spark, _orders_csv(spark, sf_dir), typed=True)
    money = F.col("o_totalprice").cast("decimal(18,2)")
    return typed.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("o_orderkey").alias("orders"),
        F.min("o_orderdate").alias("first_date"),
        F.sum(money).cast("decimal(38,2)").alias("total"),
    )


@query("""SELECT o_orderkey, o_custkey, o_orderstatus,
  CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
  o_orderpriority FROM orders""")
def csv_ingest_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as exports of two programs that order the columns differently, in one folder each."""
    path = shared_folder(spark, "orders-exports")
    rows = table(spark, sf_dir, "orders").withColumns({
        "o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"), "o_orderdate": F.col("o_orderdate").cast("date")})
    halves = {"old": (rows.columns, "o_orderkey % 2 = 0"), "new": (rows.columns[::-1], "o_orderkey % 2 <> 0")}
    for name, (columns, half) in halves.items():
        rows.filter(half).select(*columns).write.options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/{name}")
    return csv_ingest(spark, f"{path}/*", CSV_SCHEMA)


@query("""SELECT column_name, COUNT(*) AS row_count, 0::BIGINT AS malformed_lines,
  COUNT(*) FILTER (WHERE column_name = 'price_text' AND price_text IS NOT NULL AND TRY_CAST(price_text AS DECIMAL(18,2)) IS NULL
    OR column_name = 'date_text' AND date_text IS NOT NULL AND TRY_CAST(date_text AS DATE) IS NULL) AS bad_values
  FROM O, (SELECT unnest(['o_orderkey', 'price_text', 'date_text', 'status_raw']) AS column_name) GROUP BY column_name""", "O")
def ingest_account_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of an export with planted defects converts when it is read by a schema."""
    path = shared_folder(spark, "defect-orders-csv")
    orders_view(spark, sf_dir).select("o_orderkey", "price_text", "date_text", "status_raw").write.options(
        header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    flagged = csv_ingest(spark, path, "o_orderkey bigint, price_text decimal(18,2), date_text date, status_raw string", on_bad="flag")
    return ingest_account(flagged)


@query(_schema_sql("lineitem", LINEITEM_COLUMNS))
def schema_profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.schema_profile(read_table(spark, sf_dir, "lineitem"))


@query(_schema_sql("events", EVENT_COLUMNS))
def schema_profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.schema_profile(read_table(spark, sf_dir, "events"))


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def preview_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.preview(table(spark, sf_dir, "orders"), 10, "o_orderkey")


@query("""SELECT 'VARCHAR' AS inferred_type, COUNT(*) AS total_rows, COUNT(price_text) AS populated,
  COUNT(TRY_CAST(price_text AS DECIMAL(18,2))) AS parsed,
  COUNT(price_text) - COUNT(TRY_CAST(price_text AS DECIMAL(18,2))) AS failed FROM O""", "O")
def type_parse_counts_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.type_parse_counts(orders_view(spark, sf_dir), "price_text", "decimal(18,2)")


@query("SELECT COUNT(*) AS row_count FROM lineitem")
def row_count_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.row_count(table(spark, sf_dir, "lineitem"))


KEY_PROFILE_SQL = """SELECT COUNT(*) AS row_count, COUNT({k}) AS non_null_keys,
  COUNT(DISTINCT {k}) AS distinct_keys, COUNT(*) - COUNT({k}) AS null_keys,
  {blank} AS blank_keys, COUNT({k}) - COUNT(DISTINCT {k}) AS surplus_rows FROM {t}"""


@query(KEY_PROFILE_SQL.format(k="o_orderkey", t="O", blank="0::BIGINT"), "O")
def key_profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.key_profile(orders_view(spark, sf_dir), "o_orderkey")


@query(KEY_PROFILE_SQL.format(
    k="status_raw", t="O", blank="COUNT(*) FILTER (WHERE TRIM(status_raw) = '')"), "O")
def key_profile_status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.key_profile(orders_view(spark, sf_dir), "status_raw")


def _keyset_sql(table: str, keysets: list[list[str]]) -> str:
    parts = []
    for columns in keysets:
        names = ", ".join(columns)
        distinct = f"COUNT({names})" if len(columns) == 1 else "COUNT(*)"
        parts.append(
            f"SELECT '{','.join(columns)}' AS key_columns, CAST(SUM(n) AS BIGINT) AS row_count, "
            f"{distinct} AS distinct_keys, COUNT(*) FILTER (WHERE n > 1) AS repeated_keys "
            f"FROM (SELECT {names}, COUNT(*) AS n FROM {table} GROUP BY {names})"
        )
    return "\nUNION ALL ".join(parts)


LINE_KEYS = [["l_orderkey"], ["l_orderkey", "l_linenumber"],
             ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]]
ORDER_KEYS = [["o_orderkey"], ["o_custkey"], ["o_custkey", "date_text"]]


@query(_keyset_sql("lineitem", LINE_KEYS))
def composite_key_profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.composite_key_profile(table(spark, sf_dir, "lineitem"), LINE_KEYS)


@query(_keyset_sql("O", ORDER_KEYS), "O")
def composite_key_profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.composite_key_profile(orders_view(spark, sf_dir), ORDER_KEYS)


@query("""SELECT l_orderkey, l_linenumber, COUNT(*) AS occurrences FROM lineitem
  GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def duplicate_keys_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.duplicate_keys(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT o_orderkey, COUNT(*) AS occurrences FROM O
  GROUP BY o_orderkey HAVING COUNT(*) > 1""", "O")
def duplicate_keys_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.duplicate_keys(orders_view(spark, sf_dir), "o_orderkey")


@query("""SELECT * FROM O WHERE o_orderkey IN
  (SELECT o_orderkey FROM O GROUP BY o_orderkey HAVING COUNT(*) > 1)""", "O")
def duplicate_rows_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.duplicate_rows(orders_view(spark, sf_dir), "o_orderkey")


@query("""SELECT * FROM lineitem WHERE (l_orderkey, l_linenumber) IN
  (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1)""")
def duplicate_rows_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.duplicate_rows(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


CLASSIFY_SQL = """SELECT {keys}, CAST(SUM(n) AS BIGINT) AS occurrences, COUNT(*) AS distinct_rows,
  CASE WHEN COUNT(*) = 1 THEN 'exact' ELSE 'conflicting' END AS duplicate_kind
  FROM (SELECT *, COUNT(*) AS n FROM {table} GROUP BY ALL) GROUP BY {keys} HAVING SUM(n) > 1"""


@query(CLASSIFY_SQL.format(keys="o_orderkey", table="O"), "O")
def duplicate_classification_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.duplicate_classification(orders_view(spark, sf_dir), "o_orderkey")


@query(CLASSIFY_SQL.format(keys="l_orderkey, l_linenumber", table="lineitem"))
def duplicate_classification_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.duplicate_classification(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT DISTINCT * FROM O", "O")
def dedup_exact_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.dedup_exact(orders_view(spark, sf_dir), "o_orderkey")


@query("SELECT DISTINCT text, lang, source FROM documents")
def dedup_exact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.dedup_exact(
        table(spark, sf_dir, "documents").select("text", "lang", "source"), long_text=True)


@query("""SELECT user_id, CAST(ts AS DATE) AS report_date, COUNT(DISTINCT event_id) AS distinct_ids,
  COUNT(*) AS row_count FROM events GROUP BY 1, 2 HAVING COUNT(DISTINCT event_id) > 1""")
def business_grain_check_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("date").alias("report_date"))
    return keys.business_grain_check(events, ["user_id", "report_date"], "event_id")


@query(_per_column(O_COLUMNS, "COUNT(*) - COUNT({c}) AS null_count", "O"), "O")
def null_profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.null_profile(orders_view(spark, sf_dir))


@query(_per_column(LINEITEM_COLUMNS, "COUNT(*) - COUNT({c}) AS null_count", "lineitem"))
def null_profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.null_profile(table(spark, sf_dir, "lineitem"))


@query(_per_column(O_TEXT, "COUNT(*) FILTER (WHERE TRIM({c}) = '') AS blank_count", "O"), "O")
def blank_profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.blank_profile(orders_view(spark, sf_dir))


@query(_per_column(O_TEXT, "COUNT(*) FILTER (WHERE {c} <> TRIM({c})) AS padded_count", "O"), "O")
def whitespace_profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.whitespace_profile(orders_view(spark, sf_dir))


@query(_per_column(CUSTOMER_TEXT, "COUNT(*) FILTER (WHERE {c} <> TRIM({c})) AS padded_count",
                   "customer"))
def whitespace_profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.whitespace_profile(table(spark, sf_dir, "customer"))


@query(_per_column(["pct_text"], "COUNT(*) FILTER (WHERE {c} <> TRIM({c})) AS padded_count", "U"),
       "U")
def whitespace_profile_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.whitespace_profile(updates_view(spark, sf_dir))


@query("SELECT * FROM O WHERE o_custkey IS NULL", "O")
def missing_rows_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.missing_rows(orders_view(spark, sf_dir), "o_custkey")


@query("""SELECT status_raw, COUNT(*) AS missing_rows FROM O WHERE o_custkey IS NULL
  GROUP BY status_raw""", "O")
def missing_by_group_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.missing_by_group(orders_view(spark, sf_dir), "o_custkey", ["status_raw"])


@query("""SELECT doc_id, text, n_chars FROM documents""")
def csv_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, commas and line breaks, written as CSV with doubled quotes and read by name."""
    path = shared_folder(spark, "documents-csv")
    rows = table(spark, sf_dir, "documents").select("n_chars", "text", "doc_id")
    rows.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False,
                       ignoreTrailingWhiteSpace=False).csv(path)
    return csv_ingest(spark, path, "doc_id bigint, text string, n_chars bigint", multiline=True)
