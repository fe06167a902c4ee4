"""Resampling towards a target against plain Python over whole texts, line by line or not."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import queries, resampling


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(w), [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def expected(documents, targets):
    """doc_id, n_features, weight, score, rank of each (doc_id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    found = [(i, *features(t)) for i, t in documents]
    counts = [Counter(map(bucket, f)) for *_, f in found]
    s, t = sum(counts, Counter()), Counter(bucket(f) for x in targets for f in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    rows = []
    for (i, n, f), c in zip(found, counts):
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:5 * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_registered_query(spark, sf_dir):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    targets = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert got(queries.QUERIES["op11_target_resampling"](spark, sf_dir)) == expected(documents, targets)


def test_lines_of_all_kinds(spark, monkeypatch):
    """Runs over one, two and empty lines, hot lines, long words, repeated and missing ids; many small chunks."""
    rng = np.random.default_rng(4)
    lines = ["", " ", "one", "two words", "A line that Many texts share.", "…", "é ü ß", "a-b_c 9", "\t", "x" * 700, "ü" * 300 + " y", "\r"]
    texts = ["\n".join(rng.choice(lines, int(rng.integers(0, 12)))) for _ in range(150)]
    texts += ["\n".join(f"w{rng.integers(30)}" for _ in range(int(rng.integers(15, 60)))) for _ in range(120)]
    texts += [None, "", "\n\n\n", "one", "one\ntwo", "long text " * 40_000 + "\n" + "word\n" * 5_000, *texts[:60]]
    documents = [(None if k % 50 == 7 else (k if k % 9 else 5), t) for k, t in enumerate(texts)]
    targets = ["Two words\nand w3\nw4 w5", None, "", "a line that many"] * 3
    df = spark.createDataFrame([(*d, 0, "x") for d in documents], "doc_id bigint, text string, weight int, line string").repartition(3)
    target = spark.createDataFrame([(t, 1) for t in targets], "text string, n int")
    for chunk, vocabulary in ((200_000, 300_000), (40, 10)):
        monkeypatch.setattr(resampling, "CHUNK_WORDS", chunk)
        monkeypatch.setattr(resampling, "VOCABULARY", vocabulary)
        assert got(resampling.resample_towards(df, target)) == expected(documents, targets)


def test_no_documents_and_no_target(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert resampling.resample_towards(none, none).count() == 0
    some = [(k, " ".join(f"w{k % 3}" for _ in range(25))) for k in range(40)]
    df = spark.createDataFrame(some, "doc_id bigint, text string")
    assert got(resampling.resample_towards(df, none)) == expected(some, [])


@pytest.mark.parametrize("n", [0, 1, 500])
def test_packed_lists(n):
    rng = np.random.default_rng(n)
    owner, buckets = rng.integers(0, 7, n), rng.choice([0, 1, 254, 255, 256, 510, 9999], n)
    lists = resampling.packed(buckets, owner, 7)
    back, at = resampling.unpacked(lists)
    for k in range(7):
        assert back[at[k]:at[k + 1]].tolist() == sorted(buckets[owner == k].tolist())
