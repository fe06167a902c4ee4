"""Every registered query against its DuckDB counterpart; no plan has a cross join or Python."""

import contextlib
import io
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import compare  # noqa: E402

from plumbline.plans.catalogue import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def connection(sf_dir):
    con = duckdb.connect()
    for table in compare.TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_equals_duckdb(spark, connection, sf_dir, name):
    df = QUERIES[name].run(spark, sf_dir)
    equal, message = compare.compare(spark, connection, name, sf_dir, df)
    assert equal, message
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                     "ArrowEvalPython", "MapInPandas"):
        assert operator not in text.getvalue()


def test_flagship(spark):
    import __spark_entry__ as spark_entry

    assert spark_entry.entry(spark).columns == ["status", "row_count", "net_amount"]
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
