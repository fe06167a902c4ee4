"""Results of the operators against plain Python on the smallest tables."""

import hashlib
import itertools
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.llm import fingerprint, mixing, near_join, passages, pseudonyms, queries, secret_scan
from plumbline.llm.shared import shingle_sets


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_shingle_sets_match_words(documents):
    texts = [r.text for r in documents.values()] + [None, "", " ", "a", "a b c d e f"]
    assert [len(s) for s in shingle_sets(texts, 5)] == [len(shingles(t)) for t in texts]


def components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_join(spark, sf_dir, documents):
    sets = {i: shingles(r.text) for i, r in documents.items()}
    expected = components(sets)
    got = queries.QUERIES["op5_ngram_jaccard_join"](spark, sf_dir).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}


def test_near_join_of_a_group_with_few_direct_links(spark, monkeypatch):
    """Chains, near misses and a shared line; blocks of tiles and no hints must change nothing."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(70):
        w = list(base)
        for k in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            w[k] = f"x{rng.integers(9)}"
        texts.append(" ".join(w[: int(rng.integers(50, 61))]))
    texts += [" ".join(f"u{i}_{k}" for k in range(20)) + " a line that many texts share in full" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    expected = components({i: shingles(t) for i, t in enumerate(texts)})
    for block, hints in ((512, 100), (4, 1)):
        monkeypatch.setattr(near_join, "BLOCK", block)
        monkeypatch.setattr(near_join, "HINTS", hints)
        assert {r.doc_id: r.component_id for r in near_join.ngram_jaccard_join(df).collect()} == expected


def test_fingerprints(spark, sf_dir, documents):
    ids = sorted(documents)
    got = {r.doc_id: r for r in queries.QUERIES["op3_document_fingerprints"](spark, sf_dir).collect()}
    assert sorted(got) == ids
    off = []
    for i, following in zip(ids, ids[1:] + ids[:1]):
        text, other = documents[i].text, documents[following].text
        half = len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        off.append(abs(len(a & b) / max(1, len(a | b)) - got[i].near_edited))
    assert np.mean(off) < 0.06 and max(off) < 0.35
    same = {}
    for i in ids:
        same.setdefault(documents[i].text, set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_fingerprints_merge_and_estimate(spark):
    rng = np.random.default_rng(1)
    a = [f"w{x}" for x in rng.integers(0, 10**6, 1500)]
    df = spark.createDataFrame([("whole", " ".join(a)), ("one", " ".join(a[:800])), ("two", " ".join(a[796:]))], "k string, t string")
    got = {r.k: r for r in df.select("k", fingerprint.sketch_of(F.col("t")).alias("s")).collect()}
    pair = spark.createDataFrame([(got["one"].s, got["two"].s, got["whole"].s)], "a array<bigint>, b array<bigint>, w array<bigint>")
    row = pair.select(fingerprint.merge(F.col("a"), F.col("b")).alias("m"), "w",
                      fingerprint.distinct_shingles(F.col("w")).alias("n"),
                      fingerprint.containment(F.col("a"), F.col("w")).alias("inside"),
                      fingerprint.resemblance(F.col("a"), F.col("w")).alias("like")).first()
    assert row.m == row.w
    assert abs(row.n / 1496 - 1) < 0.4 and row.inside > 0.75 and abs(row.like - 796 / 1496) < 0.25
    parts = spark.createDataFrame([(1, got["one"].s), (1, got["two"].s)], "k int, s array<bigint>")
    assert fingerprint.merge_by(parts, "k", "s").first().s == got["whole"].s


def test_exact_repeats_are_found(spark, sf_dir, documents):
    seen = {}
    for i, r in documents.items():
        w = words(r.text)
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k:k + 50]), set()).add(i)
    expected = {i for v in seen.values() if len(v) > 1 for i in v}
    got = queries.QUERIES["op6_substring_dedup"](spark, sf_dir).collect()
    assert expected <= {r.doc_id for r in got}
    for r in got:
        assert all(0 <= s.start and s.end - s.start >= 50 and s.end <= r.n_words for s in r.spans)


@pytest.mark.parametrize("n", [45, 46, 47, 100, 700])
def test_compact_windows_are_the_tree(n):
    v = np.random.default_rng(n).integers(0, 1 << 62, n).astype(np.uint64)
    expected = []
    for c in range(n):
        a, b = c, c
        while a > 0 and v[a - 1] > v[c]:
            a -= 1
        while b < n - 1 and v[b + 1] >= v[c]:
            b += 1
        if b - a + 1 >= 46:
            expected.append((a, c, b))
    assert list(zip(*passages.compact_windows(v, 46))) == expected


def test_passages_with_substitutions(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"f{x}" for x in rng.integers(0, 10**9, n)]
    passage = fresh(90)
    changed = list(passage)
    changed[40] = "other"
    rows = [(1, fresh(30) + passage + fresh(30)), (2, fresh(80) + changed + fresh(5)), (3, fresh(200)), (4, fresh(10) + passage[:35] + fresh(10))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(df).collect()}
    assert set(got) == {1, 2} and got[1].spans[0].start <= 35 and got[1].spans[0].end >= 115


def test_exact_repeats_in_the_buckets_of_a_frequent_line(spark):
    """Each pair shares 50 words of which 35 are a line of all texts, so that most buckets belong to others."""
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"f{x}" for x in rng.integers(0, 10**9, n)]
    line, texts = fresh(35), [fresh(60) for _ in range(300)]
    texts = [t[:30] + line + t[30:] for t in texts]
    for k in range(0, 100, 2):
        tail = fresh(15)
        texts[k][65:80] = texts[k + 1][65:80] = tail
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(df).collect()}
    for k in range(100):
        assert got[k].partner_id == k ^ 1 and got[k].spans[0].start <= 30 and got[k].spans[0].end >= 80


def test_passages_with_added_words(spark):
    """Nine of ten pairs with a window pair at 0.75 or more are found; a pair without one never is."""
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"f{x}" for x in rng.integers(0, 10**9, n)]
    texts, wanted = [], []
    for k in range(400):
        passage = fresh(int(rng.integers(50, 61)))
        changed = list(passage)
        for _ in range(int(rng.integers(1, 3))):
            at = int(rng.integers(5, len(changed) - 5))
            changed[at:at + int(rng.integers(0, 2))] = fresh(int(rng.integers(0, 2)))
        pair = [fresh(40) + passage + fresh(40), fresh(25) + changed + fresh(50)]
        texts += pair
        a, b = ([w[i:i + 5] for i in range(len(w) - 4)] for w in pair)
        a, b = ([{tuple(x) for x in s[i:i + 46]} for i in range(len(s) - 45)] for s in (a, b))
        wanted.append(any(100 * len(p & q) >= 75 * len(p | q) for p in a for q in b if p & q))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.partner_id for r in passages.repeated_passages(df).collect()}
    found = [got.get(2 * k) == 2 * k + 1 for k in range(400)]
    assert sum(wanted) >= 150 and not any(f and not w for f, w in zip(found, wanted))
    assert sum(f and w for f, w in zip(found, wanted)) >= 0.9 * sum(wanted)


def test_like_windows_match_sets():
    rng = np.random.default_rng(3)
    for n in (400, 60):
        x = rng.integers(0, n, 120).astype(np.uint64)
        y = np.concatenate([x[20:50], rng.integers(0, n, 1).astype(np.uint64), x[50:110]])
        windows = passages.Windows(x, y, 46, 75)
        sets = lambda v: [set(v[i:i + 46].tolist()) for i in range(len(v) - 45)]
        a, b = sets(x), sets(y)
        good = [(i, j) for i in range(10, 50) for j in range(40) if 100 * len(a[i] & b[j]) >= 75 * len(a[i] | b[j])]
        i, j = zip(*good)
        assert windows.alike(10, 49, 0, 39) == (min(i), max(i) + 46, min(j), max(j) + 46)


def like_windows(texts):
    """For each text the other texts with a window of 50 words at 0.75 or more, and the words of its windows that have one."""
    tokens = [[tuple(w[i:i + 5]) for i in range(len(w) - 4)] for w in texts]
    windows = [[frozenset(t[i:i + 46]) for i in range(len(t) - 45)] for t in tokens]
    partners, inside = [set() for _ in texts], [set() for _ in texts]
    for i in range(len(texts)):
        for j in range(i):
            if 4 * len(set(tokens[i]) & set(tokens[j])) < 3 * min(map(len, windows[i] + windows[j]), default=99):
                continue
            for a, p in enumerate(windows[i]):
                for b, q in enumerate(windows[j]):
                    if 100 * len(p & q) >= 75 * len(p | q):
                        partners[i].add(j)
                        partners[j].add(i)
                        inside[i].update(range(a, a + 50))
                        inside[j].update(range(b, b + 50))
    return partners, inside


def check_passages(spark, texts, full=True):
    partners, inside = like_windows(texts)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(df).collect()}
    assert set(got) == {i for i, p in enumerate(partners) if p}
    for i, r in got.items():
        assert r.partner_id in partners[i]
        found = {w for s in r.spans for w in range(s.start, s.end)}
        assert found <= inside[i] and (not full or found == inside[i])
    return partners


def test_near_repeats_behind_a_frequent_line(spark):
    """Each pair shares 50 words of which one differs and 20 or 34 are a line of all texts, so no window is equal."""
    rng = np.random.default_rng(21)
    fresh = lambda n: [f"f{x}" for x in rng.integers(0, 10**9, n)]
    for size in (20, 34):
        line, texts = fresh(size), []
        for _ in range(60):
            rest = fresh(50 - size)
            changed = list(rest)
            changed[len(rest) // 2 if size == 34 else -3] = "other"
            texts += [fresh(20) + line + rest + fresh(20), fresh(20) + line + changed + fresh(20)]
        partners = check_passages(spark, texts)
        assert sum(map(bool, partners)) >= 60


def test_near_repeats_that_a_bucket_hides(spark):
    """A long line of all texts with words after it that two texts share, apart from the line: only the line's run is long enough."""
    rng = np.random.default_rng(22)
    fresh = lambda n: [f"f{x}" for x in rng.integers(0, 10**9, n)]
    line, texts = fresh(38), []
    for _ in range(40):
        rest = fresh(11)
        texts += [fresh(9) + line + ["one"] + rest + fresh(9), fresh(9) + line + ["two"] + rest + fresh(9)]
    partners = check_passages(spark, texts)
    assert all(p == {i ^ 1} for i, p in enumerate(partners))


def test_passages_of_repetitive_texts(spark):
    """Few words, repeated lines, lines moved and texts of one word."""
    rng = np.random.default_rng(23)
    texts = [["la"] * n for n in (50, 90, 300)] + [["na", "la"] * n for n in (30, 60)]
    for words in (2, 3, 6):
        some = [f"v{x}" for x in rng.integers(0, words, 30)]
        texts += [some + some, some[5:] + some + [f"u{words}"] * 3, some[:20] + ["x"] + some[10:] + some[::-1]]
    for _ in range(12):
        line = [f"w{x}" for x in rng.integers(0, 40, 12)]
        other = [f"w{x}" for x in rng.integers(0, 40, 30)]
        texts += [line * 3 + other, other + line * 2 + ["y"] + line, line + other + line[::-1] + other]
    check_passages(spark, texts, full=False)


def test_keys_of_several_texts_at_once():
    """The same places as text by text, also of repetitive and short texts; runs across two texts count for nothing."""
    rng = np.random.default_rng(31)
    texts = [rng.integers(1, [2, 3, 8, 30, 1000][int(rng.integers(0, 5))], int(rng.integers(1, 160))).astype(np.uint64) for _ in range(200)]
    texts = [t for x in texts for t in (x, x[:60])]
    words, at = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    tokens = passages.rolling(words, 5)
    got = passages.key_places(tokens, words, passages.mix(tokens), 46, 75, at)
    expected = []
    for b, e in zip(at[:-1], at[1:]):
        if e - b >= 5:
            own = passages.rolling(words[b:e], 5)
            expected += (b + passages.key_places(own, words[b:e], passages.mix(own), 46, 75)).tolist()
    assert got.tolist() == expected and len(expected) > 100


def test_pairs_without_repeated_tokens_count_none(monkeypatch):
    """Windows around each hit are compared without counting the distinct tokens of all windows anew."""
    rng = np.random.default_rng(32)
    x = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    y = np.delete(x, np.arange(25, 400, 50))
    pair = [passages.Packed(t.tobytes(), np.zeros(1, np.int32).tobytes(), np.zeros(1, np.int32).tobytes(), 46) for t in (x, y)]
    calls, old = [], passages.distinct_counts
    monkeypatch.setattr(passages, "distinct_counts", lambda *a: calls.append(1) or old(*a))
    pairs = passages.Comparison(*pair, 46, 75)
    assert pairs.may()
    _, p, q = np.intersect1d(x, y, return_indices=True)
    one = np.ones(len(p), np.int64)
    pairs.compare(p, one, q, one)
    assert pairs.in_x[:390].all() and pairs.in_y.all() and not calls


def test_rarest_tokens_of_windows():
    """The tokens of each window that is asked about, by how many texts hold them, as in a plain loop."""
    rng = np.random.default_rng(33)
    tokens = np.concatenate([rng.integers(1, 40, 90), rng.integers(1, 1 << 40, 160)]).astype(np.uint64)
    known = np.unique(tokens[rng.random(len(tokens)) < 0.95])
    counts = rng.integers(2, 9, len(known))
    held, asked = np.arange(20, 220, 7), np.array([100, 150])
    row = (7, held, asked, tokens.tobytes(), np.zeros(1, np.int32).tobytes(), np.zeros(1, np.int32).tobytes(), known.view(np.int64), counts)
    batch = pd.DataFrame([row], columns=["class_id", "held", "asked", "tokens", "begin", "offset", "known", "counts"])
    found = pd.concat(passages._prefixes(46, 75)(iter([batch])))
    got = {(r.token, r.asks, r.weak, r.full, p) for r in found.itertuples() for p in r.places}
    number, expected = dict(zip(known.tolist(), counts.tolist())), set()
    for s in range(len(tokens) - 45):
        window = tokens[s:s + 46].tolist()
        size = len(set(window))
        own = sorted({(number[t], t) for t in window if t in number})
        if not any(s <= p < s + 46 for p in held) or 100 * len(own) < 75 * size:
            continue
        dead = size - len(own)
        for k, (_, t) in enumerate(own[:max(0, size + -75 * size // 100 + 1 - dead)]):
            weak = size == 46 and k >= 46 - 40 + 1 - dead
            expected.add((t, any(s <= p < s + 46 for p in asked), weak, size == 46, s + window.index(t)))
    assert got == expected and len({e[1:4] for e in expected}) > 3
    assert len(found) == len({e[:4] for e in expected})


def test_tokens_are_counted_in_all_texts(spark):
    """The order of the tokens follows how many of all texts hold them, copies in a task counted once."""
    rng = np.random.default_rng(34)
    fresh = lambda n: [f"f{x}" for x in rng.integers(0, 10**9, n)]
    lines, texts = {n: fresh(8) for n in (12, 40, 300)}, [fresh(9) for _ in range(9_000)]
    for n, line in lines.items():
        for k in rng.choice(len(texts), n, replace=False):
            texts[k] = texts[k] + line + fresh(1) + line
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([*texts, *texts[:50]])], "doc_id bigint, text string").coalesce(1)
    counted = df.selectExpr("doc_id", "text", "xxhash64(text) AS text_hash").mapInPandas(
        passages._documents, "doc_id long, text_hash long, class_id long, n_words long, slice int, counts binary")
    levels = passages._frequent(counted.filter("counts IS NOT NULL"), len(texts))
    for n, line in lines.items():
        (words, _), = passages._words_of([" ".join(line)])
        got = levels[passages._counters(passages.rolling(words, 5))]
        assert (got >= int(2 * np.log2(n * 4_000 / 9_000))).all() and np.median(got) == int(2 * np.log2(n * 4_000 / 9_000))
    assert (levels > 0).sum() < 40


def compared_pairs(monkeypatch, df):
    """The result, and how many pairs of texts were written to be compared."""
    counts, old = [0], passages.scratch

    def counted(df, purpose):
        out = old(df, purpose)
        counts[0] += out.count() if purpose == "pairs" else 0
        return out

    with monkeypatch.context() as m:
        m.setattr(passages, "scratch", counted)
        return {r.doc_id: r for r in passages.repeated_passages(df).collect()}, counts[0]


def test_comparisons_follow_the_texts_that_repeat_words(spark, monkeypatch):
    """Texts of repeated words, of which the first are too short to be a passage: equal sets of tokens need no comparison."""
    rng = np.random.default_rng(35)
    runs = [[(f"w{x}", int(rng.integers(52, 70) if i > 11 else 30)) for x in rng.choice(12, 3, replace=False)] for i in range(172)]
    pairs = []
    for n in (52, 172):
        df = spark.createDataFrame([(i, " ".join(w for w, k in of for _ in range(k))) for i, of in enumerate(runs[:n])], "doc_id bigint, text string")
        got, count = compared_pairs(monkeypatch, df)
        pairs.append(count)
        assert set(range(12, n)) <= set(got)
        for i, of in enumerate(runs[:n]):
            begin, found = 0, {w for s in got[i].spans for w in range(s.start, s.end)} if i in got else ()
            for w, k in of:
                assert i < 12 or set(range(begin, begin + k)) <= found or not any(j != i and (w, 52) <= x for j in range(12, n) for x in runs[j] if x[0] == w)
                begin += k
    assert pairs[1] < 172 * 12


def test_texts_with_few_words_in_common_are_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(36)
    fresh = lambda n: [f"f{x}" for x in rng.integers(0, 10**9, n)]
    lines = [fresh(5) for _ in range(200)]
    texts = [fresh(30) + lines[i % 200] + fresh(30) for i in range(400)]
    shared = fresh(52)
    texts += [fresh(10) + shared + fresh(4), fresh(3) + shared + fresh(9)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    got, pairs = compared_pairs(monkeypatch, df)
    assert {i: r.partner_id for i, r in got.items()} == {400: 401, 401: 400}
    assert all(got[i].spans[0].start <= b and got[i].spans[0].end >= b + 52 for i, b in ((400, 10), (401, 3)))
    assert pairs == 1


def test_set_hashes_are_those_of_sets():
    rng = np.random.default_rng(37)
    tokens = np.concatenate([np.full(60, 5), rng.integers(1, 4, 90), rng.integers(1, 9, 90)]).astype(np.uint64)
    sets = [frozenset(tokens[i:i + 46].tolist()) for i in range(len(tokens) - 45)]
    got = passages.set_hashes(tokens, 46).tolist()
    assert len(dict(zip(sets, got))) == len(set(got)) == len(set(zip(sets, got))) > 3


@pytest.mark.parametrize("seed", range(4))
def test_shared_rows_of_a_bucket(seed):
    """Groups, heads and who can be alike, as in a plain loop."""
    rng = np.random.default_rng(seed)
    n = 400
    token, c, place = rng.integers(1, 60, n).astype(np.uint64), rng.integers(1, 30, n), rng.integers(0, 3, n).astype(np.int32)
    ids, named = c // 2 * 10 + rng.integers(0, 3, n), c % 7 > 0
    left, right, loose = rng.integers(1, 6, (30, 60, 3)), rng.integers(1, 6, (30, 60, 3)), rng.integers(0, 5, (30, 60, 3)) == 0
    key = c, token.astype(int), place
    sides = ((left[key] << 1 | loose[key]) << 32 | right[key]).astype(np.uint64)
    arrays = token, c.astype(np.int64), ids.astype(np.int64), named, place, sides
    batches = [passages._blocks([tuple(a[k::4] for a in arrays)], 1) for k in range(4)]
    got = {(r["token"], r["class_id"]): r for r in passages._members(passages.pa.Table.from_batches(batches)).to_pylist()}
    held = {}
    for k in range(n):
        held.setdefault(int(token[k]), {}).setdefault(int(c[k]), []).append((int(place[k]), int(ids[k]), bool(named[k])))
    expected = {}
    for t, of in held.items():
        meets = lambda a, b: any(left[a, t, p] == left[b, t, q] or right[a, t, p] == right[b, t, q] or loose[a, t, p] and loose[b, t, q]
                                 for p, *_ in of[a] for q, *_ in of[b])
        alone = {a: not any(meets(a, b) for b in of if a != b) for a in of}
        head = min(of, key=lambda a: (alone[a], not of[a][0][2], min(i for _, i, _ in of[a]) if of[a][0][2] else 0, a))
        for a in of if len(of) > 1 else ():
            one = all(len({p for p, *_ in of[x]}) == 1 for x in (a, head))
            expected[t, a] = (sorted({p for p, *_ in of[a]}), head, [] if a == head else sorted({p for p, *_ in of[head]}),
                              a != head and not alone[a] and (not one or meets(a, head)), alone[a], len(of))
    assert {k: (r["places"], r["head"], r["head_places"], r["met"], r["alone"], r["size"]) for k, r in got.items()} == expected
    assert len({e[3:5] for e in expected.values()}) == 3


def test_like_windows_share_a_run():
    """Windows at 0.75 or more share a key, whatever they repeat."""
    rng = np.random.default_rng(24)
    liked = 0
    for _ in range(3000):
        a = rng.integers(1, [3, 8, 30, 1000][int(rng.integers(0, 4))], 50).astype(np.uint64)
        b = list(a)
        for _ in range(int(rng.integers(0, 4))):
            at, n = int(rng.integers(0, 50)), int(rng.integers(0, 3))
            b[at:at + n] = rng.integers(1, 50, int(rng.integers(0, 3))).tolist()
        b = np.array((b + list(a))[:50], np.uint64)
        x, y = passages.rolling(a, 5), passages.rolling(b, 5)
        if 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y)):
            liked += 1
            keys = [set(t[passages.key_places(t, w, passages.mix(t), 46, 75)].tolist()) for t, w in ((x, a), (y, b))]
            assert keys[0] & keys[1]
    assert liked >= 300


def test_base_secrets(spark, sf_dir, documents):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in queries.QUERIES["op4_secret_scan"](spark, sf_dir).collect():
        text, spans = documents[r.doc_id].text, []
        spans += [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m.group(2)) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
        digest = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[3] == k for x in spans) for k in ("assign", "access", "hex")]
        assert set(filter(None, digest.split(","))) <= set(r.spans.split(","))


def test_base_rules_on_hard_cases():
    cases = {"Token: 'abcdef'": [("assign", 0, 14)], "tokenſ=abcdef": [], "secret:token: abcdefgh": [],
             "AKIA" + "A" * 15: [], "AKIA" + "A" * 16: [("access", 0, 20)], "0" * 23: [], "x" + "0" * 24: [("hex", 1, 25)]}
    for text, expected in cases.items():
        assert secret_scan.base_spans(text) == expected, text


def test_network_finds_unlisted_keys():
    rng = np.random.default_rng(0)
    plain = [f"mail{i}.host{i % 7}.example.com" for i in range(200)] + [f"chapter-{i}-of-the-long-book" for i in range(200)]
    found = [("some words " + p + " and more", 11, 11 + len(p), 0) for p in plain]
    for _ in range(300):
        key = "".join(rng.choice(list("0123456789abcdef"), 40))
        found.append((f'the token = "{key}" here', 13, 53, 1))
    network = secret_scan.fit(found)
    keys = ["".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 32)) for _ in range(50)]
    hits = [any(f["kind"] == "network" for f in secret_scan.findings_of([f"some words {k} and more"], network)[0]) for k in keys]
    misses = [any(f["kind"] == "network" for f in secret_scan.findings_of([f"see www{i}.site.example.org/page now"], network)[0]) for i in range(50)]
    assert sum(hits) >= 40 and sum(misses) <= 5


def test_raking_matches_numpy(spark):
    rng = np.random.default_rng(2)
    cells = [(s, g, t, int(rng.integers(50, 5000))) for s in "abc" for g in ("en", "de") for t in ("x", "y")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint")
    targets = {"source": {"a": 0.4, "b": 0.35, "c": 0.25}, "lang": {"en": 0.6, "de": 0.4}}
    got = {tuple(r)[:3]: r.weight for r in mixing.rake(df, ["source", "lang", "topic"], 0.2, targets, tolerance=1e-6)[0].select(
        "source", "lang", "topic", "weight").collect()}
    w = {c[:3]: 0.2 * c[3] for c in cells}
    total = sum(c[3] for c in cells)
    mass = {t: sum(c[3] for c in cells if c[2] == t) ** 0.7 for t in ("x", "y")}
    goals = [targets["source"], targets["lang"], {t: m / sum(mass.values()) for t, m in mass.items()}]
    for _ in range(200):
        for d, goal in enumerate(goals):
            for value, share in goal.items():
                s = sum(v for k, v in w.items() if k[d] == value)
                for k in w:
                    if k[d] == value:
                        w[k] *= share * 0.2 * total / s
    caps = {c[:3]: c[3] for c in cells}
    assert all(v <= caps[k] for k, v in w.items()), "the example has no capped cell"
    assert all(abs(got[k] - v) <= 1e-3 * v for k, v in w.items())


def test_raking_with_full_cells(spark):
    """Weights are the tokens times a factor of each value, or all tokens, and meet every goal (the optimum's conditions)."""
    rng = np.random.default_rng(3)
    cells = [(s, g, int(rng.integers(1, 9)) * (4000 if s == "a" else 100)) for s in "abcdefgh" for g in ("en", "de", "fr", "es")]
    weights, marginals = mixing.rake(spark.createDataFrame(cells, "source string, lang string, tokens long"), ["source", "lang"], 0.5,
                                     temperature=0.1, tolerance=1e-4)
    w = {(r.source, r.lang): (r.weight, r.tokens) for r in weights.collect()}
    rows = marginals.collect()
    total = sum(c[2] for c in cells)
    assert any(x == t for x, t in w.values()) and all(0 <= x <= t for x, t in w.values())
    assert abs(sum(x for x, _ in w.values()) - total / 2) < 1e-3 * total
    for r in rows:
        k = ("source", "lang").index(r.dimension)
        assert r.tokens == sum(c[2] for c in cells if c[k] == r.value)
        assert abs(r.reached - sum(x for key, (x, _) in w.items() if key[k] == r.value)) < 1e-6 * total
        assert abs(r.reached - r.goal) <= 1e-3 * r.goal
    # asked: one scale for the values with tokens to spare, all tokens of the others
    for dim in ("source", "lang"):
        scales = [r.asked / r.tokens ** 0.1 for r in rows if r.dimension == dim and r.asked < 0.999999 * r.tokens]
        assert max(scales) <= min(scales) * (1 + 1e-9)
        assert all(r.tokens <= scales[0] * r.tokens ** 0.1 for r in rows if r.dimension == dim and r.asked >= 0.999999 * r.tokens)


def test_goals_that_exclude_each_other(spark):
    """All of b is French, but little French is wanted: the goals meet half-way and the deviation is told."""
    df = spark.createDataFrame([("a", "en", 1000), ("b", "fr", 1000)], "source string, lang string, tokens long")
    weights, marginals = mixing.rake(df, ["source", "lang"], 0.5, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.8, "fr": 0.2}})
    w = {r.source: r.weight for r in weights.collect()}
    assert abs(w["a"] + w["b"] - 1000) < 10 and 500 < w["a"] < 800
    for r in marginals.collect():
        assert abs(r.reached - r.goal) <= 0.02 * r.goal and 0.1 < r.deviation < 1
        assert abs(r.deviation - abs(r.reached - r.asked) / r.asked) < 1e-9


def test_mixture_meets_its_goals(spark):
    """Whole documents of the next scale: half of the tokens, each marginal within one in a hundred of what was asked."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_marginals(df).collect()
    assert {r.dimension for r in rows} == {"source", "lang", "topic"}
    for dim in ("source", "lang", "topic"):
        own = [r for r in rows if r.dimension == dim]
        assert abs(sum(r.reached for r in own) / sum(r.tokens for r in own) - 0.5) < 0.005
        assert all(r.asked <= r.tokens for r in own)
        assert all(abs(r.reached - r.goal) <= 0.01 * r.goal for r in own)


def test_mixing_defaults():
    import inspect

    given = inspect.signature(mixing.mix_sources).parameters
    assert (given["budget"].default, given["temperature"].default) == (0.5, 0.5)


def test_mixture_draws_what_it_promises(spark, sf_dir):
    rows = queries.QUERIES["op2_source_mixing"](spark, sf_dir).collect()
    expected = sum(r.n_tokens * r.probability for r in rows)
    assert all(0 <= r.probability <= 1 for r in rows)
    spread = sum(r.n_tokens ** 2 * r.probability * (1 - r.probability) for r in rows) ** 0.5
    assert abs(sum(r.n_tokens for r in rows if r.sampled) - expected) < 4 * spread


@pytest.mark.parametrize("text", [
    "mail ab.c34@mail7.example.com", "+1 (017) 555-7713", "97.51.17.173", "192.168.1.20", "4111 1111 1111 1111",
    "9807915762804491", "2001-02-28", "3/4/1999", "13/4/1999", "01.12.1980", "DE89 3704 0044 0532 0130 00", "123-45-6789"])
def test_pseudonyms_keep_the_format_and_can_be_undone(text):
    key = hashlib.blake2b(b"k", digest_size=32).digest()
    new, found = pseudonyms.pseudonymize(text, key)
    assert len(found) == 1 and new != text and [f["kind"] for f in pseudonyms.pseudonymize(new, key)[1]] == [found[0]["kind"]]
    assert pseudonyms.pseudonymize(new, key, pseudonyms.restore)[0] == text
    assert pseudonyms.pseudonymize(f"x {text} y {text}", key)[0] == f"x {new} y {new}"
    assert pseudonyms.pseudonymize(text, bytes(32))[0] != new


def test_permutation_is_one_to_one():
    for size in (1, 2, 7, 100, 365):
        assert sorted(pseudonyms.permute(v, size, b"k", b"t") for v in range(size)) == list(range(size))


def test_language_and_toxicity_on_held_out_rows(spark):
    import os

    folder = os.environ.get("TESTDATA_DIR", "/root/testdata") + "/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = [r for r in queries.QUERIES["op8_language_id"](spark, folder).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.97
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    scored = [r for r in queries.QUERIES["op1_toxicity"](spark, folder).collect() if r.doc_id in toxic]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in scored if r.held_out]) > 0.93
    assert sum(r.predicted and not toxic[r.doc_id] for r in scored) <= 0.02 * len(scored)


def test_conversations_come_back_in_order(spark, sf_dir):
    source = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    got = queries.QUERIES["op10_quotation_threads"](spark, sf_dir).collect()
    assert len(got) == len(source)
    for r in got:
        assert r.text == source[r.conv_id, r.turn].text
        assert r.parent_turn == (r.turn - 1 if r.turn else None) and r.depth == r.turn and r.root_turn == 0


def test_contaminated_documents(spark, sf_dir, documents):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    whole = {i: {k for k, t in items.items() if t in r.text} for i, r in documents.items()}
    got = {r.doc_id: set(r["items"]) for r in queries.QUERIES["op9_benchmark_decontamination"](spark, sf_dir).collect()}
    assert all(v <= got.get(i, set()) for i, v in whole.items())
    eight = {tuple(w[k:k + 8]) for t in items.values() for w in [re.findall(r"\w+", t.lower())] for k in range(len(w) - 7)}
    for i in set(documents) - set(got):
        w = re.findall(r"\w+", documents[i].text.lower())
        assert sum(tuple(w[k:k + 8]) in eight for k in range(len(w) - 7)) < 8


def test_pipeline(spark, sf_dir, documents):
    import corpus_pipeline

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    out = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r.doc_id for r in out}
    assert len(ids) == len(out) and ids <= set(documents)
    sets = {r.doc_id: shingles(documents[r.doc_id].text) for r in out}
    assert len(set(components(sets).values())) == len(out)
    assert not any(re.search(r'token = "[0-9a-f]{24}', r.text) for r in out)
    assert all(r.n_chars == len(r.text) for r in out)


@pytest.mark.parametrize("n_words, changes", [(1500, 85), (120, 3)])
def test_near_join_of_a_dense_group_at_the_threshold(spark, monkeypatch, n_words, changes):
    """Hundreds of texts whose likeness is about the threshold: exact components, and far fewer pairs than all."""
    rng = np.random.default_rng(n_words)
    base = [f"b{i}" for i in range(n_words)]
    texts = []
    for _ in range(300):
        w = list(base)
        for k in rng.choice(n_words, int(rng.integers(changes - 1, changes + 2)) // (1 + (n_words > 500)), replace=False):
            w[k] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    followed = []
    verify = near_join._verify
    monkeypatch.setattr(near_join, "_verify", lambda base, classes, sizes, pairs, percent: followed.append(pairs.count()) or verify(
        base, classes, sizes, pairs, percent))
    got = {r.doc_id: r.component_id for r in near_join.ngram_jaccard_join(df).collect()}
    assert got == components({i: shingles(t) for i, t in enumerate(texts)})
    assert followed[1] <= 6000, "most of the 44,850 pairs must stay in the tiles"


def test_equal_sets_only(spark):
    texts = ["a b c d e f", "A b c d e f", "a b c d e f g", "x", "x", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_join.ngram_jaccard_join(df, percent=100).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5}


def test_pairs_leave_the_first_large_tile_only(monkeypatch):
    """Against all tiles at once: the same pairs, each from one large tile."""
    rng = np.random.default_rng(2)
    sets = {c: np.sort(rng.choice(np.arange(1, 60, dtype=np.uint64), 53, replace=False)) for c in range(40)}
    rows = []
    for c, h in sets.items():
        for place, x in enumerate(h[:near_join.prefix_length(len(h), 75)]):
            rows.append(dict(shingle=int(x), band=0, class_id=c, place=place, n_shingles=len(h), component=c, high=0, block=0,
                             block_a=0, block_b=0, bits=near_join.bitmap_of(h), earlier=[int(v) for v in h[:place]]))
    import pandas as pd
    frame = pd.DataFrame(rows).sort_values(["shingle", "band", "block_a", "block_b"], ignore_index=True)
    found = {}
    for large in (False, True):
        narrow = frame.assign(large=large)
        if not large:
            narrow["bits"] = [near_join.fold(np.frombuffer(b, np.uint64), near_join.NARROW).tobytes() for b in narrow["bits"]]
        out = pd.concat(list(near_join._tile_pairs(75)(iter([narrow]))))
        found[large] = sorted(zip(out["a"], out["b"]))
    linked = {(a, b) for a, b in itertools.combinations(sets, 2)
              if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert linked <= set(found[True]) <= set(found[False]) and linked
    assert len(set(found[True])) == len(found[True])


def test_comparisons_follow_the_classes_of_a_group(spark, monkeypatch):
    """Every text is compared with a few others, in all passes together, though nearly all pairs share shingles."""
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(400):
        w = [f"b{i}" for i in range(120)]
        for k in rng.choice(120, int(rng.integers(1, 6)), replace=False):
            w[k] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    followed = []
    verify = near_join._verify
    monkeypatch.setattr(near_join, "_verify", lambda base, classes, sizes, pairs, percent: followed.append(pairs.count()) or verify(
        base, classes, sizes, pairs, percent))
    got = {r.doc_id: r.component_id for r in near_join.ngram_jaccard_join(df).collect()}
    assert got == components({i: shingles(t) for i, t in enumerate(texts)})
    assert sum(followed) <= 10 * len(texts), followed
