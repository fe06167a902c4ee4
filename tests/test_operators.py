"""Operators against small tables whose right answers are worked out by hand or in Python."""

import contextlib
import datetime as dt
import io
import random
from collections import Counter
from decimal import Decimal as D
from functools import partial

import pytest
from pyspark.sql import functions as F

from plumbline.operators import (
    categorical, completeness, dates, exposure, keys, numeric, parsing, referential, rules,
    sequence, structure,
)
from plumbline.functions import parsing as parse
from plumbline.sources.tables import written


def rows(df, *order):
    df = df.orderBy(*order) if order else df
    return [r.asDict() for r in df.collect()]


def one(df):
    (row,) = df.collect()
    return row.asDict()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key, copies, conflicts, NULLs and blanks."""
    rng = random.Random(1)
    data = []
    for i in range(1500):
        key = "hot" if rng.random() < 0.34 else rng.choice([f"k{rng.randrange(300)}", None, " "])
        data.append((key, rng.randrange(3), rng.choice(["x", "y", None])))
    return data, spark.createDataFrame(data, "k string, a int, b string").cache()


def test_schema_profile(spark):
    df = spark.createDataFrame(
        [(1, "a", D("1.50"), [1.0]), (2, None, None, None)],
        "i int, s string, d decimal(10,2), v array<float>")
    got = [(r["column_name"], r["column_type"], r["populated"], r["total_rows"])
           for r in rows(structure.schema_profile(df), "position")]
    assert got == [("i", "INTEGER", 2, 2), ("s", "VARCHAR", 1, 2),
                   ("d", "DECIMAL(10,2)", 1, 2), ("v", "FLOAT[]", 1, 2)]


def test_key_profile_matches_a_count(skewed):
    data, df = skewed
    counts = Counter(k for k, _, _ in data)
    got = one(keys.key_profile(df, "k"))
    named = {k: n for k, n in counts.items() if k is not None}
    assert got == {
        "row_count": 1500, "non_null_keys": sum(named.values()), "distinct_keys": len(named),
        "null_keys": counts[None], "blank_keys": counts[" "],
        "surplus_rows": sum(named.values()) - len(named),
    }


def test_composite_keys_and_duplicates(skewed):
    data, df = skewed
    pairs = Counter((k, a) for k, a, _ in data)
    profile = {r["key_columns"]: r for r in rows(
        keys.composite_key_profile(df, [["k"], ["k", "a"]]))}
    assert profile["k,a"]["distinct_keys"] == len(pairs)
    assert profile["k"]["distinct_keys"] == len({k for k, _, _ in data} - {None})
    found = {(r["k"], r["a"]): r["occurrences"] for r in rows(keys.duplicate_keys(df, ["k", "a"]))}
    assert found == {p: n for p, n in pairs.items() if n > 1}
    assert keys.duplicate_rows(df, ["k", "a"]).count() == sum(found.values())


def test_duplicate_classification(skewed):
    data, df = skewed
    groups = {}
    for k, a, b in data:
        groups.setdefault((k, a), []).append(b)
    expected = {p: (len(v), len(set(v)), "exact" if len(set(v)) == 1 else "conflicting")
                for p, v in groups.items() if len(v) > 1}
    got = {(r["k"], r["a"]): (r["occurrences"], r["distinct_rows"], r["duplicate_kind"])
           for r in rows(keys.duplicate_classification(df, ["k", "a"]))}
    assert got == expected


@pytest.mark.parametrize("long_text", [False, True])
def test_dedup_keeps_one_copy_and_refuses_conflicts(spark, skewed, long_text):
    dedup_exact = partial(keys.dedup_exact, long_text=long_text)
    data, df = skewed
    unique = dedup_exact(df)
    assert Counter(map(tuple, unique.collect())) == Counter(set(data))
    assert Counter(map(tuple, dedup_exact(unique).collect())) == Counter(set(data))
    with pytest.raises(keys.ConflictingDuplicates):
        dedup_exact(df, "k")
    assert dedup_exact(df, "k", on_conflict="keep").count() == len(set(data))
    exact = spark.createDataFrame([(1, None), (1, None), (2, "b")], "k int, v string")
    assert dedup_exact(exact, "k").count() == 2
    half_null = spark.createDataFrame([(1, None), (1, "b")], "k int, v string")
    with pytest.raises(keys.ConflictingDuplicates):
        dedup_exact(half_null, "k")


def test_business_grain(spark):
    df = spark.createDataFrame(
        [("p", 1, "u1"), ("p", 1, "u1"), ("p", 2, "u2"), ("p", 2, "u3"), (None, 1, "u4"),
         (None, 1, "u5")], "p string, d int, id string")
    got = [(r["p"], r["d"], r["distinct_ids"], r["row_count"])
           for r in rows(keys.business_grain_check(df, ["p", "d"], "id"), F.asc_nulls_last("p"))]
    assert got == [("p", 2, 2, 2), (None, 1, 2, 2)]


def test_completeness(spark):
    df = spark.createDataFrame([("a", 1, " x"), ("", None, None), ("  ", 2, "y")],
                               "s string, n int, t string")
    nulls = {r["column_name"]: r["null_count"] for r in rows(completeness.null_profile(df))}
    blanks = {r["column_name"]: r["blank_count"] for r in rows(completeness.blank_profile(df))}
    padded = {r["column_name"]: r["padded_count"] for r in rows(completeness.whitespace_profile(df))}
    assert nulls == {"s": 0, "n": 1, "t": 1}
    assert blanks == {"s": 2, "t": 0}
    assert padded == {"s": 1, "t": 1}
    assert completeness.missing_rows(df, "n").count() == 1
    assert one(completeness.missing_by_group(df, "n", ["s"])) == {"s": "", "missing_rows": 1}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, v decimal(10,2), d date")
    assert one(keys.key_profile(empty, "k"))["row_count"] == 0
    assert one(keys.key_profile(empty, "k"))["surplus_rows"] == 0
    assert {r["total_rows"] for r in rows(completeness.null_profile(empty))} == {0}
    assert one(numeric.range_profile(empty, ["v"], 0, 1))["minimum"] is None
    assert rows(numeric.extreme_rows(empty, ["v"])) == []
    assert one(rules.rule_reconciliation(empty, F.col("v"), F.col("v")))["reconciles"] is True
    assert one(exposure.exposure_summary(empty, "k", F.col("v")))["maximum"] == 0
    assert rows(sequence.block_starts(empty, ["d"], "k")) == []


def test_categories(spark):
    df = spark.createDataFrame([("A",), ("a ",), ("A",), (None,), ("B",), ("General",)], "v string")
    found = rows(categorical.value_frequency(df, "v"))
    assert found[0] == {"value": "A", "display": "[A]", "row_count": 2}
    assert found[-1] == {"value": None, "display": None, "row_count": 1}
    variants = categorical.variant_rows(df, "v", ["A", "B"], watch=["General"])
    assert sorted(r["v"] for r in rows(variants)) == ["General", "a "]
    mapping = {"a": "A", "b": "B"}
    for given in (mapping, spark.createDataFrame(list(mapping.items()), "value string, standard string")):
        std = categorical.standardize_map(df, "v", given, "s")
        assert Counter(r["s"] for r in rows(std)) == {"A": 3, "B": 1, None: 2}
        kept = categorical.standardize_map(df, "v", given, "s", keep_unmapped=True)
        assert Counter(r["s"] for r in rows(kept)) == {"A": 3, "B": 1, "General": 1, None: 1}
    large = {f"v{i}": "x" for i in range(300)} | mapping
    assert Counter(r["s"] for r in rows(categorical.standardize_map(df, "v", large, "s"))) == {
        "A": 3, "B": 1, None: 2}


def test_keyed_correction(spark):
    df = spark.createDataFrame([(1, "P1"), (2, None), (3, "P9"), (None, "P4")], "id int, p string")
    fixes = {2: "P3", 3: "P7"}
    table = spark.createDataFrame(list(fixes.items()), "key int, value string")
    for given in (fixes, table):
        got = {r["id"]: (r["p"], r["std"], r["std_corrected"]) for r in rows(
            categorical.keyed_correction(df, "id", "p", given, "std"))}
        assert got == {1: ("P1", "P1", False), 2: (None, "P3", True), 3: ("P9", "P7", True),
                       None: ("P4", "P4", False)}


def test_parse_profile_adds_up(spark):
    values = ["2024-01-05", "1/5/2024", "31/31/1998", None, "1/5/2024", ""]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    text = F.col("t")
    got = one(parsing.parse_profile(
        df, "t", {"direct": parse.parse_ymd(text), "fallback": parse.parse_mdy(text)}))
    assert got == {"total_rows": 6, "populated": 5, "direct": 1, "fallback": 2, "failed_all": 2}
    failures = parsing.parse_failure_values(df, "t", parse.parse_ymd(text))
    assert {r["value"]: r["row_count"] for r in rows(failures)} == {
        "1/5/2024": 2, "31/31/1998": 1, "": 1}
    assert parsing.fallback_date_rows(df, "t", "d").count() == 2


def test_numeric_profiles(spark):
    df = spark.createDataFrame(
        [(D("-1.50"),), (D("0.00"),), (D("100.00"),), (D("100.25"),), (None,)], "v decimal(10,2)")
    got = one(numeric.range_profile(df, ["v"], 0, 100))
    assert (got["testable"], got["zero_count"], got["negative_count"]) == (4, 1, 1)
    assert (got["below_low_count"], got["at_low_count"]) == (1, 1)
    assert (got["above_high_count"], got["at_high_count"]) == (1, 1)
    assert one(numeric.fractional_profile(df, ["v"]))["fractional_count"] == 2
    loss = one(numeric.scale_loss_profile(df, "v"))
    assert [loss[f"changed_at_{s}"] for s in range(4)] == [2, 1, 0, 0]
    assert loss["lossless_scale"] == 2
    assert one(numeric.precision_profile(df, ["v"]))["integer_digits"] == 3
    assert numeric.out_of_range_rows(df, "v", "p", low=0, high=100).count() == 2


def test_ties_at_the_extremes_all_show(spark):
    df = spark.createDataFrame([(1, 5), (2, 1), (3, 5), (4, None)], "id int, v int")
    got = sorted((r["id"], r["extreme"]) for r in rows(numeric.extreme_rows(df, ["v"])))
    assert got == [(1, "maximum v"), (2, "minimum v"), (3, "maximum v")]
    constant = spark.createDataFrame([(1, 5)], "id int, v int")
    assert numeric.extreme_rows(constant, ["v"]).count() == 2


@pytest.fixture(scope="module")
def costs(spark):
    return spark.createDataFrame(
        [(1, D("40.00"), D("10.00"), D("400.00")),
         (2, D("40.00"), D("10.00"), D("525.00")),
         (3, D("1.00"), None, D("38.96")),
         (4, D("2.00"), D("0.01"), D("0.01"))],
        "id int, hours decimal(10,2), rate decimal(10,2), cost decimal(10,2)")


def test_rules(costs):
    expected, cost = F.round(F.col("hours") * F.col("rate"), 2), F.col("cost")
    got = one(rules.rule_reconciliation(costs, expected, cost))
    assert got == {"matching": 1, "mismatching": 2, "untestable": 1, "total_rows": 4,
                   "classified": 4, "reconciles": True}
    histogram = {r["difference"]: r["row_count"] for r in rows(
        rules.mismatch_histogram(costs, expected, cost))}
    assert histogram == {D("125.00"): 1, D("-0.01"): 1}
    assert [r["id"] for r in rows(rules.mismatch_rows(costs, expected, cost, D("125.00")))] == [2]
    other = F.col("hours") * 0 + F.lit(D("525.00"))
    overlap = one(rules.formula_overlap(costs.filter("rate is not null"), expected, other, cost))
    assert overlap == {"testable": 3, "neither": 1, "second_only": 1, "first_only": 1, "both": 0}
    outcomes = rules.formula_outcome_rows(costs, expected, other, cost, ["second_only"])
    assert [r["id"] for r in rows(outcomes)] == [2]


def test_sum_rule(spark):
    df = spark.createDataFrame(
        [(1, D("10.00"), D("5.00"), D("15.00")), (2, D("10.00"), D("5.00"), D("14.00")),
         (3, None, D("5.00"), D("14.00"))], "id int, a decimal(10,2), b decimal(10,2), t decimal(10,2)")
    (bad,) = rows(rules.sum_rule_mismatches(df, ["a", "b"], "t"))
    assert (bad["id"], bad["calculated_total"], bad["variance"]) == (2, D("15.00"), D("-1.00"))


def test_missing_value_from_a_rule(costs):
    cost = F.col("cost")
    implied = F.round(cost / F.col("hours"), 2).cast("decimal(10,2)")
    derived = rules.derive_missing(
        costs, "rate", implied, lambda c: F.round(F.col("hours") * c, 2) == cost)
    got = {r["id"]: (r["rate"], r["rate_candidate"], r["rate_inferred"], r["rate_confirmed"])
           for r in rows(derived)}
    assert got[3] == (None, D("38.96"), True, True)
    assert got[1] == (D("10.00"), None, False, None)


def test_candidate_grid_finds_the_single_solution(spark):
    target = spark.createDataFrame([("T", D("43.57"), D("1697.49"))],
                                   "id string, hours decimal(10,2), cost decimal(10,2)")
    found = rows(rules.candidate_search(
        target, 2700, 6800, 2, lambda c: F.round(F.col("hours") * c, 2), F.col("cost")))
    assert [(r["candidate"], r["matching_candidates"], r["candidates_tried"]) for r in found] == [
        (D("38.96"), 1, 4101)]
    wide = rows(rules.candidate_search(target, 0, 200_000, 2, lambda c: c, F.col("cost")))
    assert [(r["candidate"], r["matching_candidates"]) for r in wide] == [(D("1697.49"), 1)]
    with pytest.raises(ValueError):
        rules.candidate_search(target, 2, 1, 2, lambda c: c, F.col("cost"))


@pytest.mark.parametrize("grid", [(0, 0), (1, 2), (-300, 300), (2700, 6800), (5, 1030)])
def test_halving_the_grid_finds_what_the_whole_grid_finds(spark, grid):
    rng = random.Random(grid[1])
    data = [(i, D(rng.randrange(-900, 900)) / 100, D(rng.randrange(-50_000, 300_000)) / 100) for i in range(300)]
    data += [(i, h, (h * rng.randint(*grid) / 100).quantize(D("0.01"))) for i, h, _ in data]
    data += [(1, D(0), D(0)), (2, None, D(1)), (3, D(1), None), (4, D("0.01"), D("0.03"))]
    df = spark.createDataFrame(data, "id int, hours decimal(10,2), cost decimal(18,2)")
    formula = lambda c: F.round(F.col("hours") * c, 2)
    whole, halved = (rules.candidate_search(df, *grid, 2, formula, F.col("cost"), m) for m in (False, True))
    assert whole.columns == halved.columns and whole.dtypes == halved.dtypes
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, halved.collect()))


def test_dates(spark):
    d = dt.date
    df = spark.createDataFrame(
        [(d(2024, 1, 1), d(2024, 1, 3)), (d(2024, 1, 3), d(2024, 1, 3)), (d(2024, 1, 9), d(2024, 1, 3)),
         (None, d(2024, 1, 3))], "a date, b date")
    got = one(dates.date_relation_profile(df, F.col("a"), F.col("b"), d(2024, 1, 8)))
    assert (got["before_anchor"], got["on_anchor"], got["after_anchor"]) == (1, 1, 1)
    assert (got["null_count"], got["after_cutoff"]) == (1, 1)
    assert one(dates.date_gap_rows(df, F.col("a"), F.col("b")))["gap_days"] == 2
    profile = rows(dates.date_range_profile(df, {"a": F.col("a"), "b": F.col("b")}, d(2024, 1, 2)))
    assert [(r["null_count"], r["after_cutoff"]) for r in profile] == [(1, 2), (0, 4)]


@pytest.mark.parametrize("fold", [None, True, False])
def test_timelines(spark, fold):
    d = dt.date
    dim = spark.createDataFrame(
        [("p", d(2024, 1, 2), d(2024, 1, 4)), ("p", d(2024, 1, 2), d(2024, 1, 4)), ("q", None, None)],
        "id string, start date, end date")
    facts = spark.createDataFrame(
        [("p", d(2024, 1, 1)), ("p", d(2024, 1, 3)), ("p", d(2024, 1, 9)), ("p", d(2024, 1, 5)),
         ("q", d(2024, 1, 1)), ("zz", d(2024, 1, 1)), (None, d(2024, 1, 1))], "id string, day date")
    got = one(dates.timeline_violations(
        facts, dim, "id", "day", {"early": "start"}, {"late": "end"}, d(2024, 1, 8), fold))
    assert got == {"total_rows": 7, "early": 1, "late": 2, "after_cutoff": 1}
    over = one(dates.overrun_by_group(facts, dim, "id", "day", "end", ["id"], fold=fold))
    assert over == {"id": "p", "late_rows": 2, "first_late_date": d(2024, 1, 5),
                    "last_late_date": d(2024, 1, 9), "max_days_beyond": 5}


def test_facts_fold_before_the_join_only_where_they_repeat(spark):
    dim = spark.range(50).selectExpr("id", "date'2024-01-10' as end")
    def aggregates(facts):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            dates.overrun_by_group(facts, dim, "id", "day", "end", ["id"]).explain()
        return text.getvalue().count("HashAggregate")
    alone = spark.range(3000).selectExpr("id % 50 as id", "date_add(date'2000-01-01', cast(id as int)) as day")
    often = spark.range(3000).selectExpr("id % 50 as id", "date_add(date'2024-01-01', cast(id % 20 as int)) as day")
    assert aggregates(often) == aggregates(alone) + 2


def test_pages_of_values(spark, monkeypatch):
    from plumbline.operators import ordering

    monkeypatch.setattr(ordering, "MIN_ROWS_PER_RANGE", 500)
    hot = spark.range(20_000).selectExpr("'a' as e", "date'2024-01-01' as d", "if(id % 4000 = 7, null, cast(id % 9000 as int)) as v")
    few = spark.createDataFrame([("b", None, 2), ("b", None, 1), ("b", None, 2), (None, None, None)], "e string, d date, v int")
    got = dates.entity_date_pages(hot.unionByName(few), "e", "d", "v", 100).collect()
    pages = {(r["e"], r["page"]): r["values"] for r in got}
    assert pages["b", 0] == [1, 2] and pages[None, 0] == [None] and len(pages) == 93
    assert [v for k in range(91) for v in pages["a", k]] == [*range(9000), None]
    assert all(len(pages["a", k]) == 100 for k in range(90))
    with pytest.raises(ValueError):
        dates.entity_date_pages(few, "e", "d", "v", 0)


def test_conflicting_dimension_stops_the_job(spark):
    dim = spark.createDataFrame([("p", 1), ("p", 2)], "id string, v int")
    facts = spark.createDataFrame([("p",)], "id string")
    with pytest.raises(Exception, match="differing dimension rows for p"):
        referential.enrich_join(facts, dim, "id").collect()
    half = spark.createDataFrame([("p", 1), ("p", None)], "id string, v int")
    with pytest.raises(Exception, match="differing dimension rows"):
        referential.enrich_join(facts, half, "id").collect()


def test_hot_key_join_is_split(spark):
    """A key with a third of all facts is spread over several tasks of the shuffled join."""
    settings = {"spark.sql.shuffle.partitions": "32",
                "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        facts = written(spark.range(0, 120_000, 1, 8).selectExpr(
            "if(id % 3 = 0, 7, id % 5000) as k", "uuid() as payload"), "facts")
        dim = written(spark.range(10_000).selectExpr("id % 5000 as k", "id % 5000 as v"), "dim")
        for joined in (referential.enrich_join(facts, dim, "k"),
                       referential.enrich_join(facts, dim, "k", how="left"),
                       referential.lookup_rows(facts, "k", dim.select("k"))):
            assert len(joined.collect()) == 120_000
            text = io.StringIO()
            with contextlib.redirect_stdout(text):
                joined.explain()
            assert "skew=true" in text.getvalue()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_rollup_lists_keep_null_last(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame(
        [("e", day, "p2", D("1.5")), ("e", day, None, D("2.0")), ("e", day, "p1", D("1.0")),
         ("e", day, "p1", D("1.0")), ("f", day, "p1", D("9.0"))],
        "e string, d date, p string, h decimal(10,4)")
    got = one(dates.entity_date_rollup(df, "e", "d", "p", {"ps": "p"}, {"hours": F.col("h")}))
    assert (got["e"], got["row_count"], got["distinct_ids"]) == ("e", 4, 2)
    assert got["ps"] == ["p1", "p2", None]
    assert got["hours"] == D("5.5")


def test_weekdays(spark):
    df = spark.createDataFrame([("e", dt.date(2024, 1, 1)), ("e", dt.date(2024, 1, 1)),
                                ("f", dt.date(2024, 1, 7)), ("f", None)], "e string, d date")
    got = [(r["weekday_number"], r["weekday_name"], r["entity_dates"])
           for r in rows(dates.weekday_distribution(df, "e", F.col("d")))]
    assert got == [(1, "Monday", 1), (7, "Sunday", 1)]


def test_orphans(spark, skewed):
    data, df = skewed
    parent = spark.createDataFrame([("hot",), ("k1",), ("k2",), (None,)], "id string")
    counts = Counter(k for k, _, _ in data)
    expected = {k: n for k, n in counts.items() if k not in ("hot", "k1", "k2")}
    got = {r["k"]: r["row_count"] for r in rows(referential.orphan_counts(df, parent, "k", "id"))}
    assert got == expected
    plain = {r["k"] for r in rows(referential.orphan_keys(df, parent, "k", "id"))}
    assert plain == set(expected) - {None}
    report = one(referential.enrich_report(df, parent.withColumnRenamed("id", "k"), "k"))
    assert report["fact_rows"] == 1500
    assert report["unmatched_rows"] == sum(expected.values())
    assert report["matched_rows"] + report["unmatched_rows"] == 1500


def test_standardized_orphans(spark):
    child = spark.createDataFrame([("p1", " Labor"), ("p1", "labor"), ("p9", "x")], "p string, c string")
    parent = spark.createDataFrame([("p1", "Labor")], "p string, c string")
    assert referential.orphan_keys(child, parent, ["p", "c"]).count() == 3
    fold = F.lower(F.trim(F.col("c")))
    left = referential.standardized_orphans(
        child, parent, {"p": (F.col("p"), F.col("p")), "c": (fold, fold)})
    assert rows(left) == [{"p": "p9", "c": "x"}]


def test_lookups(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(500)], "id int, g int")
    assert referential.lookup_rows(df, "id", [3, 3, 4], ["g"]).count() == 2
    assert referential.lookup_rows(df, "id", list(range(250, 900))).count() == 250
    presence = rows(referential.key_presence({"a": (df, "id"), "b": (df, "g")}, 3))
    assert {r["table_name"]: r["row_count"] for r in presence} == {"a": 1, "b": 71}


def test_falls_and_histories(spark):
    d = lambda n: dt.date(2024, 1, n)
    df = spark.createDataFrame(
        [("a", d(1), 1, 10), ("a", d(2), 2, 105), ("a", d(3), 3, 77), ("b", d(1), 4, 5),
         ("b", d(3), 5, 5), ("c", d(1), 6, 9), ("c", d(2), 7, 8), ("c", d(3), 8, None),
         ("c", d(4), 9, 1)], "p string, day date, id int, v int")
    fell = rows(sequence.monotonic_violations(df, "p", ["day", "id"], "v", ranges=3), "id")
    assert [(r["id"], r["previous_value"], r["decrease"]) for r in fell] == [(3, 105, 28), (7, 9, 1)]
    affected = sequence.affected_histories(
        df, "p", ["day", "id"], "v", at={"day": d(3)}, ranges=3)
    assert sorted(r["id"] for r in rows(affected)) == [1, 2, 3]
    history = rows(sequence.entity_history(df, "p", "c", "day"))
    assert [r["id"] for r in history] == [6, 7, 8, 9]


def test_blocks_skip_null_values(spark):
    df = spark.createDataFrame(
        [(1, "x"), (2, None), (3, "x"), (4, "y"), (5, "x")], "id int, v string")
    got = rows(sequence.block_starts(df, ["id"], "v", ranges=4), "id")
    assert [(r["id"], r["previous_value"]) for r in got] == [(1, None), (4, "x"), (5, "y")]
    context = rows(sequence.neighbor_context(df, ["id"], "v", F.col("v") == "y", ranges=4))
    assert [(r["previous_value"], r["next_value"]) for r in context] == [("x", "x")]


def test_exposure(spark):
    df = spark.createDataFrame(
        [("paid", D("100.00")), ("Paid ", D("50.00")), ("approved", D("30.00")),
         ("applied", D("-5.00")), ("pending", D("7.00")), ("void", D("1.00")), (None, D("2.00"))],
        "s string, a decimal(10,2)")
    got = {r["status"]: (r["row_count"], r["net_amount"]) for r in rows(
        exposure.status_exposure(df, "s", F.col("a")))}
    assert got["paid"] == (2, D("150.00"))
    summary = one(exposure.exposure_summary(df, "s", F.col("a")))
    assert summary == {"incurred": D("175.00"), "pending": D("7.00"), "all_statuses": D("185.00"),
                       "maximum": D("182.00"), "unassigned": D("3.00")}
