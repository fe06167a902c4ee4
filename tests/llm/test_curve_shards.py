"""Shards along the curve: laws, order, skew, messy tables, and files that filters can skip."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries
from plumbline.llm.curve_shards import files_holding, hilbert_index, hilbert_shards, shard_manifest, write_shards


@pytest.mark.parametrize("dimensions, bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions))).T
    place = hilbert_index(cells, bits)
    assert sorted(place) == list(range(cells.shape[1]))
    along = cells[:, np.argsort(place)]
    assert (np.abs(np.diff(along, axis=1)).sum(axis=0) == 1).all()


def expected(rows, shards):
    """doc_id, shard, slot of each (doc_id, a, b): cells by rank with NULL first, ties by id with NULL last."""
    cells = []
    for d in (1, 2):
        key = lambda v: (v is not None, v if v is not None else 0)
        values = sorted(key(r[d]) for r in rows)
        cells.append([256 * values.index(key(r[d])) // len(rows) for r in rows])
    place = hilbert_index(np.array(cells), 8)
    order = sorted(range(len(rows)), key=lambda k: (place[k], rows[k][0] is None, rows[k][0] or 0))
    out, begin = [], {}
    for at, k in enumerate(order):
        shard = at * shards // len(rows)
        out.append((rows[k][0], shard, at - begin.setdefault(shard, at)))
    return sorted(out, key=repr)


def test_rows_against_plain_python(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(rng.integers(50)) if rng.random() < 0.8 else None, str(rng.choice(["x", "y", "é", "zz", None]))) for k in range(900)]
    rows = [(k, a, None if b == "None" else b) for k, a, b in rows]
    rows += [(k, 7, "hot") for k in range(2000, 2500)] + [(None, 7, "hot"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, a int, b string").repartition(6)
    got = hilbert_shards(df, ["a", "b"], shards=7, ties=["doc_id"]).select("doc_id", "shard", "slot").collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows, 7)


def test_equal_bytes(spark):
    rng = np.random.default_rng(7)
    rows = [(k, int(rng.integers(1, 400)), "a" if k % 3 else "b") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, size bigint, b string")
    got = hilbert_shards(df, ["size", "b"], law="bytes", size_col="size", ties=["doc_id"]).collect()
    sums = np.bincount([r.shard for r in got], [r["size"] for r in got], 16)
    assert len(got) == 3000 and max(abs(sums - sum(sums) / 16)) <= 400
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_registered_query_holds_its_law(spark, sf_dir):
    import zlib

    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.QUERIES["op12_hilbert_shards"](spark, sf_dir).collect()
    counts = np.bincount([r.shard for r in got], minlength=16)
    assert len(got) == len(text) and counts.max() - counts.min() <= 1
    assert all(r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)


def test_messy_and_empty_tables(messy, empty):
    clash = messy.withColumns({"shard": F.lit("s"), "curve": F.lit("c"), "row": F.lit("r"), "t0": F.lit(1), "range": F.lit(2), "at": F.lit(3)})
    got = hilbert_shards(clash, ["lang", "source", "n_chars"], shards=5, ties=["doc_id", "text"]).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted((k * 5 // 12, k - -(-(k * 5 // 12) * 12 // 5)) for k in range(12))
    assert {(r.row, r.t0, r.range, r["at"]) for r in got} == {("r", 1, 2, 3)}
    assert hilbert_shards(empty, ["lang"]).count() == 0
    with pytest.raises(ValueError):
        hilbert_shards(messy, ["lang"], law="key")
    with pytest.raises(ValueError):
        hilbert_shards(messy, ["lang"], law="bytes")


def test_files_are_skipped_on_every_dimension(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(k, int(rng.integers(1000)), int(rng.integers(1000)), f"text {k}") for k in range(8000)]
    df = spark.createDataFrame(rows, "doc_id bigint, a int, b int, text string")
    path = f"{tmp_path}/shards"
    write_shards(hilbert_shards(df, ["a", "b"], ties=["doc_id"]), path, files_per_shard=2)
    back = spark.read.parquet(path)
    assert sorted(r.text for r in back.select("text").collect()) == sorted(r[3] for r in rows)
    manifest = shard_manifest(spark, path, ["a", "b"]).cache()
    assert manifest.count() == 32 and manifest.agg(F.sum("n_rows")).first()[0] == 8000
    for column in ("a", "b"):
        files = [r.file for r in files_holding(manifest, {column: (400, 450)}).collect()]
        assert len(files) <= 14
        assert spark.read.parquet(*files).filter(f"{column} BETWEEN 400 AND 450").count() == df.filter(f"{column} BETWEEN 400 AND 450").count()
    assert files_holding(manifest, {"a": (0, 60), "b": (0, 60)}).count() <= 3
