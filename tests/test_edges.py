"""Arguments that leave the clean corner: NULL keys, shifted NULLs, long lists, odd numbers, odd CSV."""

import datetime as dt
from decimal import Decimal as D
from functools import partial

import pytest
from pyspark.sql import functions as F

from plumbline.functions import parsing as parse
from plumbline.operators import categorical, keys, numeric, parsing, referential, rules, sequence, structure
from plumbline.plans import entity_cleaning as plans
from plumbline.sources.tables import BAD_VALUES, CORRUPT, csv_ingest, ingest_account, scratch_run, write_cleaned, written


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [200, 201])
def test_lists_of_any_length(spark, n):
    df = spark.createDataFrame([("o1", 1, "A0"), ("o2", 2, "a1 "), ("o3", 900, "zz"), ("o4", None, None)], "o string, k int, v string")
    fixed = categorical.keyed_correction(df, "k", "k", {i: -i for i in range(n)}, "std")
    assert fixed.columns == ["o", "k", "v", "std", "std_corrected"]
    assert dict(fixed.dtypes)["std"] == "int"
    assert rows(fixed) == [("o1", 1, "A0", -1, True), ("o2", 2, "a1 ", -2, True), ("o3", 900, "zz", 900, False), ("o4", None, None, None, False)]
    assert rows(categorical.variant_rows(df, "v", [f"a{i}" for i in range(n)])) == [("o1", 1, "A0"), ("o2", 2, "a1 ")]
    std = categorical.standardize_map(df, "v", {f"a{i}": f"std{i}" for i in range(n)}, "std", keep_unmapped=True)
    assert [r[3] for r in rows(std)] == ["std0", "std1", "zz", None]
    found = referential.lookup_rows(df, "k", list(range(n)))
    assert found.columns == df.columns and rows(found) == [("o1", 1, "A0"), ("o2", 2, "a1 ")]
    assert referential.lookup_rows(df, "k", spark.range(n).selectExpr("cast(id as int) as x")).columns == df.columns


def test_a_fix_to_null_and_two_spellings_of_a_standard(spark):
    df = spark.createDataFrame([(1, "F"), (2, "f"), (3, "F ")], "k int, v string")
    assert rows(categorical.keyed_correction(df, "k", "v", {1: None, 2: "x"}, "s")) == [
        (1, "F", None, True), (2, "f", "x", True), (3, "F ", "F ", False)]
    assert rows(categorical.variant_rows(df, "v", ["F", "f"])) == [(3, "F ")]


@pytest.mark.parametrize("long_text", [False, True])
def test_duplicate_guard_compares_values(spark, long_text):
    dedup_exact = partial(keys.dedup_exact, long_text=long_text)
    shifted = spark.createDataFrame([(1, None, "x"), (1, "x", None)], "k int, a string, b string")
    with pytest.raises(keys.ConflictingDuplicates):
        dedup_exact(shifted, "k")
    unknown = spark.createDataFrame([(None, "a"), (None, "b"), (None, "b"), (1, "c"), (1, "c")], "k int, v string")
    assert rows(dedup_exact(unknown, "k")) == [(1, "c"), (None, "a"), (None, "b")]
    assert rows(dedup_exact(unknown, "k", null_keys="drop")) == [(1, "c")]
    with pytest.raises(keys.ConflictingDuplicates):
        dedup_exact(unknown, "k", null_keys="conflict")


def test_null_keys_of_a_dimension_join_nothing(spark):
    facts = spark.createDataFrame([(1, "f1"), (None, "f2")], "k int, f string")
    dim = spark.createDataFrame([(1, "d"), (None, "x"), (None, "y")], "k int, d string")
    assert rows(referential.enrich_join(facts, dim, "k")) == [(1, "f1", "d")]
    assert rows(referential.enrich_join(facts, dim, "k", "left")) == [(1, "f1", "d"), (None, "f2", None)]


def test_nested_key_sets(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 2, "b"), (None, 2, "b")], "k int, l int, m string")
    got = rows(keys.composite_key_profile(df, [["k"], ["k", "l"], ["k", "l", "m"], ["m"]]))
    assert got == [("k", 4, 1, 1), ("k,l", 4, 3, 1), ("k,l,m", 4, 4, 0), ("m", 4, 2, 2)]


def test_csv_by_name_with_flags(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as out:
        out.write('b,a\n1,"he ""said"" so, yes"\nbad,two\n3,three,surplus\n')
    good = str(tmp_path / "y.csv")
    with open(good, "w") as out:
        out.write('b,a\n1,"he ""said"" so, yes"\n')
    assert rows(csv_ingest(spark, good, "a string, b int")) == [('he "said" so, yes', 1)]
    flagged = csv_ingest(spark, path, "a string, b int", on_bad="flag")
    got = {r["a"]: (r["b"], r[CORRUPT] is not None, r[BAD_VALUES]) for r in flagged.collect()}
    assert got['he "said" so, yes'] == (1, False, []) and got["two"] == (None, False, ["b"])
    assert got["three"][1]
    for call in (lambda: csv_ingest(spark, path, "a string, b int").collect(), lambda: csv_ingest(spark, path).collect()):
        with pytest.raises(Exception, match="does not convert|malformed"):
            call()
    with pytest.raises(ValueError):
        csv_ingest(spark, path, "a string, c int")


def test_duplicates_are_exact_when_digests_collide(spark, monkeypatch):
    """All rows share one digest: rows and conflicts are still told apart, key by key."""
    monkeypatch.setattr(keys, "row_digest", lambda df: [F.lit(1).cast("bigint"), F.lit(2).cast("bigint")])
    data = [(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "d"), (None, "d")]
    df = spark.createDataFrame(data, "k int, v string")
    assert sorted(rows(keys.dedup_exact(df, long_text=True)), key=repr) == sorted(set(data), key=repr)
    assert sorted(rows(keys.dedup_exact(df, "k")), key=repr) == sorted(set(data), key=repr)
    with pytest.raises(keys.ConflictingDuplicates):
        keys.dedup_exact(df.unionAll(spark.createDataFrame([(2, "z")], "k int, v string")), "k", long_text=True)


def test_duplicate_removal_shuffles_no_text(spark):
    import contextlib
    import io

    df = spark.range(2000).selectExpr("id % 1990 as k", "repeat(cast(id % 1990 as string), 50) as text", "if(id % 3 = 0, double('-0.0'), 0.0) * 0 as z")
    got = keys.dedup_exact(df.withColumn("z", F.when(F.col("k") < 5, F.col("z")).otherwise(F.lit(float("nan")))), long_text=True)
    assert got.count() == 1990 and got.select("k").distinct().count() == 1990
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        got.explain()
    assert "Exchange hashpartitioning" not in text.getvalue()
    alone = spark.range(50).selectExpr("id as k", "cast(id as string) as v")
    assert keys.dedup_exact(alone, "k", long_text=True) is alone


def _file(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_csv_files_with_other_column_orders(spark, tmp_path):
    """Columns are matched by name within each file; files with other columns are refused."""
    path = _file(tmp_path / "mixed dir", "a 1.csv", "a,b\n1,2\n")
    _file(tmp_path / "mixed dir", "b.csv", "b,a\n20,10\n")
    _file(tmp_path / "mixed dir", "c.csv", "")
    assert sorted(rows(csv_ingest(spark, path))) == [("1", "2"), ("10", "20")]
    assert sorted(rows(csv_ingest(spark, path, typed=True))) == [(1, 2), (10, 20)]
    assert sorted(rows(csv_ingest(spark, path, "b int"))) == [(2,), (20,)]
    _file(tmp_path / "mixed dir", "d.csv", "a,c\n5,6\n")
    assert sorted(rows(csv_ingest(spark, path, "a int"))) == [(1,), (5,), (10,)]
    for call in (lambda: csv_ingest(spark, path), lambda: csv_ingest(spark, path, "a int, b int")):
        with pytest.raises(ValueError, match="d.csv"):
            call()
    nothing = _file(tmp_path / "nothing", "c.csv", "")
    assert csv_ingest(spark, nothing, "a int").count() == 0


def test_typed_csv_loses_nothing(spark, tmp_path):
    """Surplus and missing fields stop or are flagged, as with a schema."""
    bad = _file(tmp_path / "bad", "x.csv", "a,b\n1,x\n2,y,surplus\n3\n")
    with pytest.raises(Exception, match="malformed"):
        csv_ingest(spark, bad, typed=True).collect()
    flagged = csv_ingest(spark, bad, typed=True, on_bad="flag")
    assert flagged.schema["a"].dataType.simpleString() == "int"
    got = {r["a"]: (r["b"], r[CORRUPT]) for r in flagged.collect()}
    assert got == {1: ("x", None), 2: ("y", "2,y,surplus"), 3: (None, "3")}
    assert sorted(rows(ingest_account(flagged))) == [("a", 3, 2, 0), ("b", 3, 2, 0)]
    given = csv_ingest(spark, _file(tmp_path / "given", "x.csv", "a,b\n1,2\nx,3\n"), "a int, b int", on_bad="flag")
    assert sorted(rows(ingest_account(given))) == [("a", 2, 0, 1), ("b", 2, 0, 0)]


def test_inferred_types(spark, tmp_path):
    text = ("flag,small,large,huge,half,day,moment,year,mixed,none,pad,code\n"
            "true,1,3000000000,12345678901234567890123,1.5,2024-01-02,2024-01-02 03:04:05,2024,1,, 1,007\n"
            "FALSE,-2,4,5,2,2024-1-3,2024-01-02,2024-05-06,x,,2,010\n")
    kinds = csv_ingest(spark, _file(tmp_path / "kinds", "x.csv", text), typed=True).dtypes
    assert [k for _, k in kinds] == ["boolean", "int", "bigint", "decimal(38,0)", "double", "date", "timestamp", "string",
                                     "string", "string", "string", "int"]


def test_sink_keeps_values(spark, tmp_path):
    df = spark.createDataFrame([("007", 1), (None, 2)], "p string, v int")
    back = write_cleaned(df, str(tmp_path / "raw_out"), [str(tmp_path / "raw")], ["p"])
    assert back.dtypes == df.dtypes and rows(back) == rows(df)
    with pytest.raises(Exception, match="empty text"):
        write_cleaned(spark.createDataFrame([("", 1)], "p string, v int"), str(tmp_path / "other"), [], ["p"])


def test_scratch_is_cleared(spark):
    from pathlib import Path

    with scratch_run(spark):
        folder = Path(written(spark.range(3), "some").inputFiles()[0].removeprefix("file://")).parent
        assert folder.exists()
    assert not folder.exists()


def test_numbers_report_as_they_are(spark):
    df = spark.createDataFrame([(1e-9, D("1.5")), (float("inf"), D("2.5")), (5e-8, None)], "v double, d decimal(10,2)")
    got = {r["column_name"]: r for r in numeric.range_profile(df, ["v", "d"]).collect()}
    assert (got["v"]["minimum"], got["v"]["maximum"], got["v"]["infinite_count"], got["v"]["nan_count"]) == (1e-9, float("inf"), 1, 0)
    odd = numeric.range_profile(df.union(spark.createDataFrame([(float("nan"), None)], df.schema)), ["v"]).first()
    assert odd["nan_count"] == 1 and odd["maximum"] != odd["maximum"]
    (row,) = numeric.precision_profile(df, ["v"]).collect()
    assert row["max_abs"] == float("inf") and row["integer_digits"] is None
    assert numeric.precision_profile(df.select((F.col("v") * 0 + 1234.5).alias("v")).limit(1), ["v"]).first()["integer_digits"] == 4
    assert numeric.range_profile(df, ["d"]).first()["maximum"] == D("2.500000")


def test_dates_need_a_day_and_nothing_else(spark):
    texts = ["2023", "2023-05", "2023-05-09", "2023-05-09 garbage", "2023-05-09 10:11:12", "2023-05-09T10:11Z", "2023/5/9", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = structure.type_parse_counts(df, "t", "date").first()
    assert (got["populated"], got["parsed"], got["failed"]) == (7, 4, 3)
    assert df.select(parse.parse_ymd(F.col("t")).alias("d")).filter("d = date'2023-05-09'").count() == 4


def test_histories_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (1, "b", 1)], "day int, e string, v int")
    got = sequence.affected_histories(df, "e", ["day"], "v")
    assert got.columns == df.columns and rows(got) == [(1, "a", 5), (2, "a", 3)]


# ---- published findings, on frames that reproduce them ----------------------------------------

@pytest.fixture(scope="module")
def projects(spark):
    """97 rows with 96 ids, 21 open completions, one failing date, one failing amount, one unknown type."""
    data = []
    for i in range(1, 97):
        status = "completed" if i > 21 else "active"
        data.append((
            f"P{i:03d}", {30: "Complete", 5: " active ", 10: "on_hold", 11: "On Hold"}.get(i, status),
            None if i == 52 else "office", "8/10/2023" if i == 13 else "2024-03-01",
            "$672,000" if i == 66 else "500000.00", 400_000, None if i <= 21 else dt.date(2024, 2, 1)))
    schema = ("project_id string, project_status string, project_type string, baseline_completion_date string, "
              "original_contract_value string, original_budget int, actual_completion_date date")
    return spark.createDataFrame([*data, data[41]], schema)


def test_published_project_findings(projects):
    got = keys.key_profile(projects, "project_id").first()
    assert (got["row_count"], got["distinct_keys"], got["surplus_rows"]) == (97, 96, 1)
    duplicate = keys.duplicate_classification(projects, "project_id").first()
    assert (duplicate["project_id"], duplicate["duplicate_kind"]) == ("P042", "exact")
    assert projects.filter("actual_completion_date IS NULL").count() == 21
    failed = parsing.parse_failures(projects, "baseline_completion_date", parse.parse_ymd(F.col("baseline_completion_date")), "d")
    assert [(r["project_id"], r["baseline_completion_date"]) for r in failed.collect()] == [("P013", "8/10/2023")]
    money = parse.to_decimal(F.col("original_contract_value"), 18, 2)
    failed = parsing.parse_failures(projects, "original_contract_value", money, "m")
    assert [(r["project_id"], r["original_contract_value"]) for r in failed.collect()] == [("P066", "$672,000")]
    cleaned = {r["project_id"]: r for r in plans.clean_projects(projects).collect()}
    assert len(cleaned) == 96 and {r["std_project_status"] for r in cleaned.values()} == {"active", "completed", "on_hold"}
    assert cleaned["P066"]["std_original_contract_value"] == D("672000.00")
    assert cleaned["P052"]["std_project_type"] == "unknown"


def test_published_rate_search(spark):
    """Of 4,101 candidate rates from 27.00 to 68.00 one reproduces the cost."""
    target = spark.createDataFrame([(D("43.57"), D("1697.49"))], "hours decimal(10,2), cost decimal(10,2)")
    found = rules.candidate_search(target, 2700, 6800, 2, lambda c: F.round(F.col("hours") * c, 2), F.col("cost")).collect()
    assert [(r["candidates_tried"], r["matching_candidates"]) for r in found] == [(4101, 1)]
