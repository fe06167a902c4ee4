import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions import parsing as parse
from plumbline.functions import text


def _apply(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    got = rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in got]


def test_money(spark):
    values = ["$1,234.50", "12", " 12 ", "-1,800.00", "$-5", "1e3", "", "n/a", None, "12.345",
              "99999999999", "1.2.3"]
    got = _apply(spark, values, lambda c: parse.normalize_money(c, 10, 2))
    expected = ["1234.50", "12.00", "12.00", "-1800.00", "-5.00", "1000.00", None, None, None,
                "12.35", None, None]
    assert got == [None if v is None else Decimal(v) for v in expected]


def test_clean_money_text_is_unchanged(spark):
    values = ["0.00", "17.25", "-3.10"]
    assert [str(v) for v in _apply(spark, values, parse.normalize_money)] == values


def test_percent(spark):
    values = ["89.7%", "89.7", "105", "%", None, "12,5%"]
    got = _apply(spark, values, parse.normalize_percent)
    assert got == [Decimal("89.7"), Decimal("89.7"), Decimal("105.0"), None, None, None]
    assert _apply(spark, values, parse.has_percent_sign) == [True, False, False, True, None, True]


DATES = {
    "2023-05-09": dt.date(2023, 5, 9),
    "2023-5-9": dt.date(2023, 5, 9),
    " 2023-05-09 ": dt.date(2023, 5, 9),
    "2023/05/09": dt.date(2023, 5, 9),
    "2023 05 09": dt.date(2023, 5, 9),
    "2023-05-09 10:00": dt.date(2023, 5, 9),
    "2023": None,
    "20230509": None,
    "2023-13-01": None,
    "2023-02-30": None,
    "2023-05/09": None,
    "2023-05-09abc": None,
    "5/9/2023": None,
    "": None,
    None: None,
}


def test_year_month_day(spark):
    assert _apply(spark, list(DATES), parse.parse_ymd) == list(DATES.values())


def test_month_day_year(spark):
    values = ["5/9/2023", "05/09/2023", " 5/9/2023 ", "13/1/2023", "2/30/2023", "5/9/23",
              "5/9/12023", "2023-05-09", None]
    day = dt.date(2023, 5, 9)
    assert _apply(spark, values, parse.parse_mdy) == [day, day, day] + [None] * 6


def test_fallback_is_only_used_where_the_first_reading_fails(spark):
    values = ["2023-05-09", "5/9/2023", "31/31/1998", None]
    assert _apply(spark, values, parse.needed_fallback) == [False, True, False, False]
    day = dt.date(2023, 5, 9)
    assert _apply(spark, values, parse.parse_date_fallback) == [day, day, None, None]


def test_midnight(spark):
    stamps = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 1), None]
    assert _apply(spark, stamps, parse.at_midnight, "timestamp_ntz") == [True, False, None]


def test_text(spark):
    values = ["", "  ", " a ", "a", "\t", None]
    assert _apply(spark, values, text.is_blank) == [True, True, False, False, False, None]
    assert _apply(spark, values, text.is_padded) == [False, True, True, False, False, None]
    assert _apply(spark, [" A b ", None], text.folded) == ["a b", None]
    assert _apply(spark, [" A", None], text.bracketed) == ["[ A]", None]


def test_full_match_is_anchored(spark):
    values = ["E123", "E1234", "xE123", "E123\n", None]
    got = _apply(spark, values, lambda c: text.full_match(c, "E[0-9]{3}"))
    assert got == [True, False, False, False, None]
    assert _apply(spark, ["ab", "b"], lambda c: text.full_match(c, "a|b")) == [False, True]


def test_mapping(spark):
    got = _apply(spark, ["a", "b", None], lambda c: text.mapped(c, {"a": "A"}))
    assert got == ["A", None, None]
    got = _apply(spark, ["a", "b", None], lambda c: text.mapped(c, {"a": "A"}, c))
    assert got == ["A", "b", None]
    for entries in (200, 201, 1500):
        mapping = {str(i): f"v{i}" for i in range(entries)}
        assert _apply(spark, ["0", "199", "x", None], lambda c: text.mapped(c, mapping, c)) == ["v0", "v199", "x", None]
