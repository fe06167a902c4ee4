"""The ranged neighbours and row numbers equal a plain window, whatever the skew."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators.ordering import with_neighbors, with_ranges, with_row_numbers


def _plain(df, order, by):
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*[F.asc_nulls_last(k) for k in order])
    return df.withColumns({
        "before": F.lag("v").over(window),
        "after": F.lead("v").over(window),
        "rn": F.row_number().over(window).cast("bigint"),
    })


def _sorted(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


def _rows(n, hot_entity=0.35, hot_day=0.35, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        entity = "hot" if rng.random() < hot_entity else f"e{rng.randrange(40)}"
        day = dt.date(2024, 3, 1) if rng.random() < hot_day else (
            None if rng.random() < 0.02 else dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(200)))
        value = None if rng.random() < 0.1 else rng.randrange(5)
        rows.append((f"TX{i:06d}", i, entity if rng.random() > 0.03 else None, day, value))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        _rows(3000), "code string, id bigint, entity string, day date, v int"
    ).cache()


@pytest.mark.parametrize("order,by", [
    (["id"], []),
    (["code"], []),
    (["day", "id"], []),
    (["day", "id"], ["entity"]),
    (["day", "code"], ["entity"]),
])
@pytest.mark.parametrize("ranges", [1, 60])
def test_equals_plain_window(table, order, by, ranges):
    columns = [*table.columns, "before", "after"]
    got = with_neighbors(table, order, {"before": "v"}, {"after": "v"}, by, ranges)
    plain = _plain(table, order, by)
    assert _sorted(got, columns) == _sorted(plain, columns)
    numbered = with_row_numbers(table, order, "rn", by, ranges)
    assert _sorted(numbered, [*table.columns, "rn"]) == _sorted(plain, [*table.columns, "rn"])


def test_timestamps_order_ranges(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "v int, ts timestamp_ntz")
    got = with_neighbors(df, ["ts"], {"before": "v"}, ranges=9).orderBy("ts").collect()
    assert [r["before"] for r in got] == [None, *range(499)]


def test_no_range_keeps_a_hot_key_whole(table):
    """A third of all rows on one entity and one day still spreads over many ranges."""
    for by in ([], ["entity"]):
        ranged, numbers = with_ranges(table, ["day", "id"], by, 30)
        sizes = ranged.groupBy(*by, *numbers).count()
        largest = sizes.agg(F.max("count")).first()[0]
        assert largest <= 2 * 3000 / 30
        if not by:
            assert sizes.count() <= 2 * 30
    # Only the large group is cut; the others stay in one piece.
    cut = ranged.filter("_range > 0").select("entity").distinct().collect()
    assert {r["entity"] for r in cut} >= {"hot"}
    assert len(cut) < 10


def test_ten_hot_days_share_the_ranges(spark):
    df = spark.range(5000).selectExpr("id", "date_add(date'2024-01-01', cast(id % 10 as int)) as day")
    ranged, numbers = with_ranges(df, ["day", "id"], [], 50)
    sizes = ranged.groupBy(*numbers).count().collect()
    assert len(sizes) <= 2 * 50 and max(r["count"] for r in sizes) <= 2 * 5000 / 50


def test_a_stray_key_leaves_long_common_beginnings_balanced(spark):
    df = spark.range(4000).selectExpr("format_string('TX2026-%030d', id) as code", "id as v")
    df = df.unionAll(spark.sql("SELECT 'A' AS code, -1L AS v"))
    ranged, numbers = with_ranges(df, ["code"], [], 20)
    assert ranged.groupBy(*numbers).count().agg(F.max("count")).first()[0] <= 2 * 4001 / 20


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_rows_of_one_second_are_cut(spark, kind):
    df = spark.range(3000).selectExpr(
        f"cast(timestamp'2024-05-01 00:00:00' + make_dt_interval(0, 0, 0, id / 1000000.0) as {kind}) as ts", "id as v")
    ranged, numbers = with_ranges(df, ["ts"], [], 20)
    assert ranged.groupBy(*numbers).count().agg(F.max("count")).first()[0] <= 2 * 3000 / 20
    got = with_neighbors(df, ["ts"], {"before": "v"}, ranges=20).filter("before <> v - 1 OR (v > 0 AND before IS NULL)")
    assert got.count() == 0


def test_rows_without_any_order_key_are_cut_by_their_content(spark):
    df = spark.range(2000).selectExpr("id as v", "cast(null as bigint) as k")
    ranged, numbers = with_ranges(df, ["k"], [], 20)
    assert ranged.groupBy(*numbers).count().agg(F.max("count")).first()[0] <= 2 * 2000 / 20
    numbered = with_row_numbers(df, ["k"], "rn", ranges=20)
    assert sorted(r["rn"] for r in numbered.collect()) == list(range(1, 2001))


def test_the_end_of_daylight_saving_changes_nothing(spark):
    """The local clock goes back an hour; the order of the timestamps does not."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.range(1440).selectExpr("id as v", "timestamp_seconds(1730606400 + id * 60) as ts")
        got = with_neighbors(df, ["ts"], {"before": "v"}, {"after": "v"}, ranges=8)
        numbered = with_row_numbers(df, ["ts"], "rn", ranges=8)
        assert got.filter("before <> v - 1 OR after <> v + 1").count() == 0
        assert got.filter("before IS NULL OR after IS NULL").count() == 2
        assert numbered.filter("rn <> v + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_many_null_keys_are_cut_by_the_next_key(spark):
    rng = random.Random(5)
    data = [(i, None if rng.random() < 0.4 else rng.randrange(50), i % 3) for i in range(2000)]
    df = spark.createDataFrame(data, "id int, k int, v int")
    order = ["k", "id"]
    ranged, numbers = with_ranges(df, order, [], 20)
    assert ranged.groupBy(*numbers).count().agg(F.max("count")).first()[0] <= 2 * 2000 / 20
    columns = [*df.columns, "before", "after"]
    got = with_neighbors(df, order, {"before": "v"}, {"after": "v"}, [], 20)
    assert _sorted(got, columns) == _sorted(_plain(df, order, []), columns)
    unknown_first = df.withColumn("none", F.lit(None).cast("date"))
    ranged, numbers = with_ranges(unknown_first, ["none", "id"], [], 20)
    assert ranged.groupBy(*numbers).count().agg(F.max("count")).first()[0] <= 2 * 2000 / 20


def test_groups_of_ordinary_size_are_not_cut(spark):
    df = spark.range(2000).selectExpr("id", "id % 100 as entity", "id as v")
    ranged, numbers = with_ranges(df, ["id"], ["entity"], 16)
    assert numbers == [] and ranged.columns == df.columns


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "id bigint, v int")
    assert with_neighbors(empty, ["id"], {"before": "v"}).count() == 0
    nulls = spark.createDataFrame([(None, 1)], "id bigint, v int")
    assert with_neighbors(nulls, ["id"], {"before": "v"}).collect()[0]["before"] is None


@pytest.mark.parametrize("key", [
    "array(cast(id % 7 as int), if(id % 5 = 0, null, cast(id as int)))",
    "named_struct('a', id % 3, 'b', named_struct('c', if(id % 11 = 0, null, id), 'd', date_add(date'2024-01-01', cast(id as int))))",
    "make_dt_interval(0, 0, cast(id as int), 0)",
    "make_ym_interval(cast(id % 9 as int), cast(id as int))",
    "array(named_struct('s', format_string('common %05d', id)))",
    "cast(id as decimal(30, 7))", "if(id % 4 = 0, double('NaN'), id / 3.0)", "cast(format_string('%05d', id) as binary)",
    "if(id % 3 = 0, null, array(id))", "timestamp_seconds(id * 61)", "id % 2 = 0",
])
def test_keys_of_any_type_order_alike_at_every_size(spark, monkeypatch, key):
    """What Spark can order can be cut: no type works for a small table only."""
    from plumbline.operators import ordering

    for n in (3000,) if "interval" in key else (400, 3000):
        df = spark.range(n).selectExpr("id", f"{key} as k", "cast(id % 5 as int) as v", "id % 3 as entity")
        monkeypatch.setattr(ordering, "MIN_ROWS_PER_RANGE", 250_000)
        whole = with_neighbors(df, ["k", "id"], {"before": "v"}, {"after": "v"})
        monkeypatch.setattr(ordering, "MIN_ROWS_PER_RANGE", 300)
        cut, numbers = with_ranges(df, ["k", "id"])
        assert numbers and cut.select(*numbers).distinct().count() > 1
        columns = ["id", "v", "before", "after"]
        got = with_neighbors(df, ["k", "id"], {"before": "v"}, {"after": "v"})
        assert _sorted(got, columns) == _sorted(whole, columns)


def test_a_cut_table_is_read_once_for_its_keys_and_once_for_the_rows(table):
    import contextlib
    import io

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        with_neighbors(table, ["day", "id"], {"before": "v"}, ranges=20).explain()
    plan = text.getvalue()
    assert plan.count("InMemoryTableScan") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert all(column not in line for line in plan.splitlines() if "parquet" in line.lower() for column in ("code", "entity"))
