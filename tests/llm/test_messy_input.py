"""Each operator on NULLs, empty and long texts, ties, repeats, clashing names, and an empty table."""

import pytest
from pyspark.sql import functions as F

from plumbline.llm import (decontaminate, fingerprint, language, mixing, near_join, passages, pseudonyms, quotations,
                           secret_scan, toxicity)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by_id(df, key="doc_id"):
    out = {}
    for r in rows(df):
        out.setdefault(r[key], []).append(r)
    return out


def test_near_join(messy, empty):
    got = by_id(near_join.ngram_jaccard_join(messy))
    assert sum(map(len, got.values())) == 12
    assert {r["component_id"] for k in (1, 2, None) for r in got[k]} == {1}
    assert [r["n_shingles"] for k in (3, 4, 5) for r in got[k]] == [0, 0, 0]
    assert [r["component_id"] for k in (3, 4, 5, 6, 9) for r in got[k]] == [3, 4, 5, 6, 9]
    assert sorted(r["n_shingles"] for r in got[7]) == [1, 2]
    assert got[8][0]["n_shingles"] == 2
    assert near_join.ngram_jaccard_join(empty).count() == 0


def test_keep_one_of_each(messy, empty):
    kept = near_join.keep_one_of_each(messy)
    assert kept.columns == messy.columns
    assert sorted(r["doc_id"] for r in rows(kept)) == [1, 3, 4, 5, 6, 7, 7, 8, 9]
    assert near_join.keep_one_of_each(empty).count() == 0


def test_near_join_of_rows_without_id(spark):
    w = [f"n{i}" for i in range(100)]
    variant = lambda *at: " ".join("x" if i in at else v for i, v in enumerate(w))
    other = [f"o{i}" for i in range(60)]
    data = [(1, variant()), (None, variant(20)), (3, variant(20, 60)), (4, "alone in the world of words"),
            (None, " ".join(other)), (None, " ".join(other[:50])), (None, " ".join(other[:50]))]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = by_id(near_join.ngram_jaccard_join(df, percent=85))
    # 1 and 3 have 86 of 106 shingles in common, so only the row without an id links them.
    assert [got[k][0]["component_id"] for k in (1, 3, 4)] == [1, 1, 4]
    assert sorted(map(str, (r["component_id"] for r in got[None]))) == ["1", "None", "None", "None"]
    kept = rows(near_join.keep_one_of_each(df))
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "4", "None"]


def test_passages_of_rows_without_id(spark):
    """Each document's only partner has no id: an exact passage, or one with another word in its middle."""
    data = []
    for k in range(40):
        passage = [f"p{k}_{i}" for i in range(60)]
        changed = [*passage[:30], f"c{k}", *passage[31:]] if k % 2 else passage
        data += [(k, " ".join([f"a{k}_{i}" for i in range(40)] + passage)), (None, " ".join(changed + [f"b{k}_{i}" for i in range(40)]))]
    got = by_id(passages.repeated_passages(spark.createDataFrame(data, "doc_id bigint, text string")))
    assert set(range(0, 40, 2)) <= set(got) and len(got) >= 36
    assert all(r["partner_id"] is None and r["spans"][0]["start"] >= 30 for v in got.values() for r in v)


def test_language(messy, empty):
    got = by_id(language.identify_language(messy))
    assert [r["lang_pred"] for k in (3, 4, 5, 6) for r in got[k]] == ["und"] * 4
    assert all(r["lang_pred"] in ("en", "fr") for k in (1, 2, 7, 8, 9) for r in got[k])
    assert not got[None][0]["held_out"]
    assert language.identify_language(empty).count() == 0
    unlabelled = messy.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in rows(language.identify_language(unlabelled))} == {"und"}
    kept = language.keep_identified(messy)
    assert kept.columns == messy.columns and not {3, 4, 5, 6} & {r["doc_id"] for r in rows(kept)}


def test_decontamination(messy, empty, benchmark):
    got = by_id(decontaminate.find_contamination(messy, benchmark))
    assert [r["items"] for r in got[1]] == [[1], [1]]
    assert got[None][0]["contaminated"] and got[2][0]["items"] == [1]
    assert sorted(map(tuple, (r["items"] for r in got[7]))) == [(), (2,)]
    assert not any(r["contaminated"] for k in (3, 4, 5, 6, 8, 9) for r in got[k])
    assert decontaminate.find_contamination(empty, benchmark).count() == 0
    none = benchmark.filter("item_id > 99")
    assert not any(r["contaminated"] for r in rows(decontaminate.find_contamination(messy, none)))
    clean = decontaminate.remove_contaminated(messy, benchmark)
    assert clean.columns == messy.columns and sorted(r["doc_id"] for r in rows(clean)) == [3, 4, 5, 6, 7, 8, 9]


def test_decontamination_in_blocks(messy, benchmark, monkeypatch):
    whole = sorted(map(str, rows(decontaminate.find_contamination(messy.distinct(), benchmark))))
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 3)
    assert sorted(map(str, rows(decontaminate.find_contamination(messy.distinct(), benchmark)))) == whole
    assert decontaminate.remove_contaminated(messy, benchmark).count() == 7


def test_decontamination_of_repeated_rows_in_blocks(messy, benchmark, monkeypatch):
    whole = sorted(map(str, rows(decontaminate.find_contamination(messy, benchmark))))
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 3)
    assert len(whole) == 12
    assert sorted(map(str, rows(decontaminate.find_contamination(messy, benchmark)))) == whole


def test_secrets(messy, empty):
    got = by_id(secret_scan.scan_secrets(messy))
    (found,) = got[9][0]["findings"]
    assert (found["kind"], found["start"], found["end"]) == ("assign", 0, 21)
    assert all(not r["findings"] for k in (1, 2, 3, 4, 5, 6, 7, 8, None) for r in got[k])
    assert secret_scan.scan_secrets(empty).count() == 0
    clean = secret_scan.redact_secrets(messy)
    assert clean.columns == messy.columns and clean.count() == messy.count()
    assert by_id(clean)[9][0]["text"].startswith('[SECRET]" and mail')
    assert by_id(clean)[3][0]["text"] is None


def test_mixing(messy, empty):
    mixed = mixing.mix_sources(messy)
    assert mixed.count() == 12 and mixed.columns.count("mix_topic") == 1
    got = by_id(mixed)
    assert all(r["mix_probability"] == 0 and not r["mix_sampled"] for k in (3, 4, 5) for r in got[k])
    assert got[1][0]["mix_sampled"] == got[1][1]["mix_sampled"]
    assert mixing.mix_sources(empty).count() == 0


def test_fingerprints(messy, empty):
    got = by_id(fingerprint.fingerprint_edits(messy))
    assert sum(map(len, got.values())) == 12
    assert got[1][0]["fingerprint"] == got[2][0]["fingerprint"] == got[None][0]["fingerprint"]
    assert got[3][0]["n_chars"] == 0 and got[3][0]["fingerprint"] == "" and got[3][0]["near_edited"] == 1.0
    assert got[8][0]["n_chars"] == 300_004
    assert fingerprint.fingerprint_edits(empty).count() == 0


def test_toxicity(messy, empty, labels):
    got = by_id(toxicity.score_toxicity(messy, labels))
    assert sum(map(len, got.values())) == 12
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for v in got.values() for r in v)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert toxicity.score_toxicity(messy, labels.filter("doc_id < 0")).filter("score <> 0").count() == 0


def test_passages(messy, empty):
    got = by_id(passages.repeated_passages(messy))
    assert set(got) == {1, 2} and got[2][0]["spans"] == [{"start": 0, "end": 120}]
    assert got[2][0]["partner_id"] == 1 and len(got[1]) == 1
    assert passages.repeated_passages(empty).count() == 0


def test_pseudonyms(messy, empty):
    got = by_id(pseudonyms.pseudonymize_documents(messy, "k"))
    assert got[3][0]["text"] is None and got[4][0]["text"] == ""
    assert [f["kind"] for f in got[9][0]["found"]] == ["email"]
    assert pseudonyms.pseudonymize_documents(empty, "k").count() == 0


def test_quotations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, depth string"
    data = [
        (1, 0, "user", "First words. Second words.", "x"), (1, 1, "assistant", "> First words.\n> Second words.\nMy answer.", None),
        (1, 2, "user", "On Monday A wrote:\n>> First words.\n> My answer.\n\nThanks.", None),
        (1, 3, "user", "> > >Never written.\nHm.", None), (1, 3, "user", "> > >Never written.\nHm.", None),
        (None, 0, "user", "Alone.", None), (None, 1, None, "> Alone.", None), (2, None, "user", "> First words.\nNo turn", None),
        (3, 0, "user", None, None), (3, 1, "user", "", None), (4, 0, "user", ">" * 50_000 + " deep\n" + "word " * 50_000, None),
    ]
    df = spark.createDataFrame(data, schema)
    got = {}
    for r in rows(quotations.reply_ordered(df)):
        got.setdefault((r["conv_id"], r["turn"]), []).append(r)
    assert sum(map(len, got.values())) == len(data)
    assert [(got[1, t][0]["parent_turn"], got[1, t][0]["root_turn"], got[1, t][0]["depth"]) for t in range(4)] == [
        (None, 0, 0), (0, 0, 1), (1, 0, 2), (None, 3, 0)]
    assert got[1, 1][0]["text"] == "My answer." and got[1, 2][0]["text"] == "\nThanks."
    assert got[1, 3][0]["quoted_passages"] == 1 and got[1, 3][0]["linked_passages"] == 0
    assert got[None, 1][0]["parent_turn"] == 0 and got[None, 1][0]["text"] == ""
    assert got[2, None][0]["parent_turn"] is None and got[2, None][0]["depth"] == 0
    assert got[3, 0][0]["text"] is None
    assert quotations.reply_ordered(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages(messy, empty, spark, sf_dir, stage):
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    for docs in (messy, empty):
        out = run(spark, docs, sf_dir)
        out.collect()
        if stage < 4:
            assert out.columns == docs.columns


def test_names_that_operators_use_inside(messy):
    """Columns called like the operators' own are kept as they are."""
    clash = messy.withColumns({n: F.lit(n) for n in ("_id", "_hash", "rows", "n", "mix_rate", "shingle", "row", "line")})
    kept = near_join.keep_one_of_each(clash)
    assert kept.columns == clash.columns and {(r["_id"], r["_hash"], r["n"]) for r in rows(kept)} == {("_id", "_hash", "n")}
    mixed = mixing.mix_sources(clash)
    assert {r["mix_rate"] for r in rows(mixed)} == {"mix_rate"} and len(rows(mixed)) == 12


def test_repeats_that_differ_elsewhere_keep_one_whole_row(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 2), (1, "a b c d e f", "y", 1), (2, "other words here", "z", 3)],
                               "doc_id bigint, text string, source string, n int")
    assert sorted((r["doc_id"], r["source"], r["n"]) for r in rows(near_join.keep_one_of_each(df))) == [(1, "x", 2), (2, "z", 3)]
