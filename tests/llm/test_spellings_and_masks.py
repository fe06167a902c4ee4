"""Pseudonyms across spellings, masks against every spacing of differing tokens, blocks of test items, planted secrets."""

import hashlib
import time

import numpy as np
import pytest

from plumbline.llm import decontaminate, pseudonyms, secret_scan
from plumbline.llm.shared import word_hashes

KEY = hashlib.blake2b(b"k", digest_size=32).digest()


def replaced(text):
    new, found = pseudonyms.pseudonymize(text, KEY)
    assert len(found) == 1 and pseudonyms.pseudonymize(new, KEY, pseudonyms.restore)[0] == text
    return new


def test_a_day_has_one_pseudonym_in_every_spelling():
    for day, month in ((28, 2), (13, 12)):
        new = {tuple(map(int, replaced(f"2001{s}{month:02d}{s}{day:02d}").split(s))) for s in "-/."}
        for s in "-/.":
            d, m, y = map(int, replaced(f"{day:02d}{s}{month:02d}{s}2001").split(s))
            new.add((y, m, d))
        m, d, y = map(int, replaced(f"{month}/{day}/2001").split("/"))
        assert new == {(y, m, d)}
    assert replaced("3/4/1999").split("/")[2] == replaced("1999-03-04")[:4] == replaced("03/04/1999")[-4:]


def test_days_are_permuted_one_to_one():
    import datetime as dt

    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(400)]
    assert len({replaced(d.isoformat()) for d in days}) == 400


def test_telephone_numbers_and_addresses_in_every_spelling():
    digits = {pseudonyms.only_digits(replaced(t)) for t in ("+49 1555 1234567", "+4915551234567", "+49-1555-123-4567")}
    assert len(digits) == 1 and digits.pop().startswith("49")
    assert pseudonyms.only_digits(replaced("+1 (017) 555-7713"))[1:] == pseudonyms.only_digits(replaced("(017) 555-7713"))
    assert replaced("Bob.K@x.com").lower() == replaced("bob.k@x.com") != "bob.k@x.com"


@pytest.mark.parametrize("period", range(5, 13))
def test_some_mask_finds_every_spacing_the_score_admits(period):
    rng = np.random.default_rng(period)
    item = [f"w{k}" for k in rng.permutation(60)]
    index = decontaminate.SeedIndex([(7, word_hashes([" ".join(item).encode()])[0])])
    for phase in range(period):
        changed = [f"x{k}" if k % period == phase else w for k, w in enumerate(item)]
        (found, same), = decontaminate.matches(["some words before " + " ".join(changed)], index)
        assert found == {7} and same >= decontaminate.MIN_MATCH


def test_items_in_many_blocks(spark, monkeypatch):
    """More blocks than are held at once: the same findings and rows as with one block."""
    items = [(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(40)]
    docs = spark.createDataFrame([(k, f"before {t} after" if k % 3 else "clean text of some words") for k, t in items] * 2,
                                 "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontaminate.find_contamination(docs, benchmark).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 100)
    assert sorted(decontaminate.find_contamination(docs, benchmark).collect()) == whole
    assert sum(r.contaminated for r in whole) == 52
    assert decontaminate.remove_contaminated(docs, benchmark).count() == len(whole) - 52


def test_planted_secrets_are_found_at_the_recall_asked_for():
    """Keys in contexts that no rule knows; the threshold comes from findings that were kept back."""
    rng = np.random.default_rng(11)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    plain = [f"mail{i}.host{i % 7}.example.com" for i in range(300)] + [f"chapter-{i}-of-the-long-book" for i in range(300)]
    found = [(f"some words {p} and more", 11, 11 + len(p), 0) for p in plain]
    found += [(f'the token = "{pick("0123456789abcdef", 40)}" here', 13, 53, 1) for _ in range(400)]
    network = secret_scan.fit(found)
    texts = [f"use {pick(letters, 32)} for it" for _ in range(200)]
    hits = sum(any(f["kind"] == "network" for f in fs) for fs in secret_scan.findings_of(texts, network))
    clean = [f"read mail{i}.site{i % 5}.example.org or part-{i}-of-a-book" for i in range(200)]
    wrong = sum(len(fs) for fs in secret_scan.findings_of(clean, network))
    assert hits >= 0.9 * len(texts) and wrong <= 0.05 * len(clean)


def test_base_findings_are_scored_and_stay():
    class Never:
        threshold = 2.0

        def score(self, x):
            return np.full(len(x), 0.25)

    spans, = secret_scan.findings_of(["token = abcdef123456 and " + "0" * 30 + " and abcdef123456xyz"], Never())
    assert [(f["kind"], f["score"]) for f in spans] == [("assign", 0.25), ("hex", 0.25)]


def test_candidates_against_overlap_by_pairs():
    rng = np.random.default_rng(5)
    for _ in range(200):
        words = ["token=abcdef12345678", "0" * 26, "AKIA" + "B1" * 10, "secret:" + "a1" * 9, "word", "abc123def456ghi789", "=", " "]
        text = "".join(rng.choice(words, 12))
        base = secret_scan.base_spans(text)
        expected = [m.span() for m in secret_scan.CANDIDATE.finditer(text)
                    if any(c.isdigit() for c in m.group()) and any(c.isalpha() for c in m.group())
                    and not any(m.start() < b and a < m.end() for _, a, b in base)]
        assert secret_scan.candidates(text, base) == expected


def test_time_follows_the_findings_of_a_text():
    def seconds(run, text):
        start = time.perf_counter()
        run(text)
        return time.perf_counter() - start

    for run, word in ((lambda t: secret_scan.candidates(t, secret_scan.base_spans(t)), "token=abcdef{0} abc{0}def456ghi789 "),
                      (lambda t: pseudonyms.pseudonymize(t, KEY), "b{0}@x.com 10.1.2.3 ")):
        small, large = ("".join(word.format(k) for k in range(n)) for n in (1_000, 8_000))
        seconds(run, small)
        assert seconds(run, large) < 24 * max(seconds(run, small), 1e-3)


def test_network_learns_from_all_findings(spark, monkeypatch):
    """More findings than any task takes: all are learned or kept back, and the threshold is theirs."""
    rng = np.random.default_rng(21)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, f'the token = "{pick("0123456789abcdef", 40)}" in text {i}') for i in range(2300)]
    rows += [(i, f"read mail{i}.site{i % 5}.example.org or so") for i in range(2300, 4700)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    written = {}
    scratch = secret_scan.scratch
    monkeypatch.setattr(secret_scan, "scratch", lambda df, name: written.setdefault(name, scratch(df, name)))
    network = secret_scan.learn_network(df, shard=900)
    assert network.fitted_on == (2400, 2300)
    held = np.sort([r.logit for r in written["logits"].filter("label = 1").collect()])
    assert network.threshold == network.calibrated(held[int(0.01 * len(held))])
    again = secret_scan.learn_network(df.repartition(2), shard=900)
    assert again.threshold == network.threshold and (again.state == network.state).all()
    texts = [f"use {pick(letters, 32)} for it" for _ in range(200)]
    assert sum(any(f["kind"] == "network" for f in fs) for fs in secret_scan.findings_of(texts, network)) >= 180
    clean = [f"read mail{i}.site{i % 5}.example.org now" for i in range(200)]
    assert sum(len(fs) for fs in secret_scan.findings_of(clean, network)) <= 10
