"""Views over the test tables that plant the defects the operators look for.

Each view exists twice: as DataFrame code for Spark, and as a DuckDB common table expression for
the comparison. Both hold all rows of their table.

* ``O``: orders with NULL and orphan customers, money text, date text, status variants, blanks
  and exact duplicates.
* ``L``: lineitem with NULL discounts and recorded amounts that deviate from the formula.
* ``U``: events as progress updates per user, with planned, actual and percent text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.ordering import with_row_numbers
from plumbline.plans.tables import table
from plumbline.sources.tables import written as written_table

SQL = {
    "O": """
O_base AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 499 = 0 THEN NULL
       WHEN o_orderkey % 307 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 131 = 0 THEN concat('$', format('{:,.2f}', o_totalprice))
       ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price_text,
  CASE WHEN o_orderkey % 1009 = 0 THEN '31/31/1998'
       WHEN o_orderkey % 173 = 0 THEN strftime(o_orderdate, '%-m/%-d/%Y')
       ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date_text,
  CASE WHEN o_orderkey % 211 = 0 THEN concat(' ', lower(o_orderstatus), ' ')
       WHEN o_orderkey % 223 = 0 THEN '  ' ELSE o_orderstatus END AS status_raw
  FROM orders),
O AS (SELECT * FROM O_base UNION ALL SELECT * FROM O_base WHERE o_orderkey % 997 = 0)""",
    "L": """
L AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
  CASE WHEN l_partkey % 401 = 0 THEN NULL ELSE CAST(l_discount AS DECIMAL(4,2)) END AS disc,
  CAST(l_tax AS DECIMAL(4,2)) AS tax,
  CAST(round(CAST(l_extendedprice AS DECIMAL(12,2))
    * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))
    * (CAST(1 AS DECIMAL(4,2)) + CAST(l_tax AS DECIMAL(4,2))), 2) AS DECIMAL(18,2))
  + CAST(CASE WHEN l_suppkey % 97 = 0 THEN 125.00 WHEN l_partkey % 53 = 0 THEN -0.01
         ELSE 0.00 END AS DECIMAL(6,2)) AS recorded
  FROM lineitem)""",
    "U": """
U_rank AS (SELECT event_id, user_id, CAST(ts AS DATE) AS report_date, ts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
U_value AS (SELECT event_id, user_id, report_date, ts,
  CAST(least(rn * 15, 1000) AS DECIMAL(10,1)) / CAST(10 AS DECIMAL(3,0)) AS pl,
  CAST((event_id % 9 - 5) * 7 AS DECIMAL(10,1)) / CAST(10 AS DECIMAL(3,0)) AS dv FROM U_rank),
U AS (SELECT event_id, user_id, report_date, ts, CAST(pl AS DECIMAL(5,1)) AS planned_pct,
  CAST(pl + dv AS DECIMAL(5,1)) AS actual_pct,
  CASE WHEN event_id % 173 = 0 THEN concat(CAST(CAST(pl + dv AS DECIMAL(5,1)) AS VARCHAR), '%')
       ELSE CAST(CAST(pl + dv AS DECIMAL(5,1)) AS VARCHAR) END AS pct_text
  FROM U_value)""",
    # Line items with their order's date, by day.
    "S": """
S AS (SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority,
  CAST(l_shipdate AS DATE) AS ship_date, CAST(o_orderdate AS DATE) AS order_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
}


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    customer = F.col("o_custkey")
    day = F.col("o_orderdate")
    status = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 499 == 0, None)
        .when(key % 307 == 0, customer + 1_000_000_000)
        .otherwise(customer).alias("o_custkey"),
        F.when(key % 131 == 0, F.concat(F.lit("$"), F.format_number(price, 2)))
        .otherwise(price.cast("decimal(18,2)").cast("string")).alias("price_text"),
        F.when(key % 1009 == 0, "31/31/1998")
        .when(key % 173 == 0, F.date_format(day, "M/d/yyyy"))
        .otherwise(day.cast("date").cast("string")).alias("date_text"),
        F.when(key % 211 == 0, F.concat(F.lit(" "), F.lower(status), F.lit(" ")))
        .when(key % 223 == 0, "  ").otherwise(status).alias("status_raw"),
    )
    # The planted copies come out of the same scan.
    copies = F.when(key % 997 == 0, 2).otherwise(1)
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("_copy")


def combined_formula(price: Column, discount: Column, tax: Column) -> Column:
    """Amount after discount and tax, rounded once."""
    one = F.lit(1).cast("decimal(4,2)")
    return F.round(price * (one - discount) * (one + tax), 2).cast("decimal(18,2)")


def component_formula(price: Column, discount: Column, tax: Column) -> Column:
    """Net amount and tax rounded apart and then added."""
    one = F.lit(1).cast("decimal(4,2)")
    net = price * (one - discount)
    return (F.round(net, 2) + F.round(F.round(net, 4) * tax, 2)).cast("decimal(18,2)")


COMBINED_SQL = """CAST(round(price * (CAST(1 AS DECIMAL(4,2)) - disc)
  * (CAST(1 AS DECIMAL(4,2)) + tax), 2) AS DECIMAL(18,2))"""
COMPONENT_SQL = """CAST(round(price * (CAST(1 AS DECIMAL(4,2)) - disc), 2)
  + round(round(price * (CAST(1 AS DECIMAL(4,2)) - disc), 4) * tax, 2) AS DECIMAL(18,2))"""


def lines_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount, tax = F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    part = F.col("l_partkey")
    deviation = (
        F.when(F.col("l_suppkey") % 97 == 0, 125.00).when(part % 53 == 0, -0.01).otherwise(0.00)
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        price.alias("price"),
        F.when(part % 401 == 0, None).otherwise(discount).alias("disc"),
        tax.alias("tax"),
        (combined_formula(price, discount, tax) + deviation.cast("decimal(6,2)")).alias("recorded"),
    )


def updates_view(spark: SparkSession, sf_dir: str, written: bool = False) -> DataFrame:
    """``written=True`` puts the view into shared storage for operators that read it repeatedly."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    ranked = with_row_numbers(events, ["ts", "event_id"], "rn", by=["user_id"])
    ten = F.lit(10).cast("decimal(3,0)")
    planned = F.least(F.col("rn") * 15, F.lit(1000)).cast("decimal(10,1)") / ten
    deviation = ((F.col("event_id") % 9 - 5) * 7).cast("decimal(10,1)") / ten
    actual = (planned + deviation).cast("decimal(5,1)")
    text = actual.cast("string")
    view = ranked.select(
        "event_id", "user_id", F.col("ts").cast("date").alias("report_date"), "ts",
        planned.cast("decimal(5,1)").alias("planned_pct"),
        actual.alias("actual_pct"),
        F.when(F.col("event_id") % 173 == 0, F.concat(text, F.lit("%"))).otherwise(text)
        .alias("pct_text"),
    )
    return written_table(view, "updates") if written else view


def shipments_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two large tables joined on the order key; a hot order is split by the skew join."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "o_orderpriority",
        F.col("l_shipdate").cast("date").alias("ship_date"),
        F.col("o_orderdate").cast("date").alias("order_date"),
    )


def with_views(names: str, query: str) -> str:
    """DuckDB statement with the named views in front of it."""
    head = query.lstrip()
    tables = ",".join(SQL[name] for name in names)
    if head[:5].upper() == "WITH ":
        return f"WITH {tables},\n{head[5:]}"
    return f"WITH {tables}\n{head}"
