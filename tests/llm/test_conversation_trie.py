"""The prefix trie against plain Python: hot groups over several ranges, long and messy conversations."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries
from plumbline.llm.conversation_trie import prefix_trie, shared_openings, turn_chains

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    """Each conversation's turns, opened as the registered query opens them."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        opener = c - (c % 100 if c >= 0 else -(-c % 100))  # the remainder has the sign of c
        out[c] = own.get(opener, [])[:h] + turns[h:]
    return out


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def trie(conversations):
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for seq in members:
        if seq:
            kids.setdefault(seq[:-1], []).append(seq)
    leaves, saved, out = {}, {}, []
    for seq in sorted(members, key=len, reverse=True):
        own = (len(members[seq]) - 1) * len(seq[-1][1]) if seq else 0
        leaves[seq] = sum(leaves[k] for k in kids.get(seq, [])) or 1
        saved[seq] = own + sum(saved[k] for k in kids.get(seq, []))
        ends = ",".join(str(c) for c in sorted(members[seq]) if len(conversations[c]) == len(seq))
        out.append((min(members[seq]), len(seq), min(members[seq[:-1]]) if seq else None, len(members[seq]), len(kids.get(seq, [])),
                    leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def query_on(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    return nodes_of(queries.QUERIES["op13_conversation_trie"](spark, str(tmp_path)))


def test_registered_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes_of(queries.QUERIES["op13_conversation_trie"](spark, sf_dir)) == trie(rebuilt(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_tries_over_many_ranges(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(400):
        rows += [(c, t, "u" if t % 2 else "a", f"x{rng.integers(1 + seed)}") for t in range(int(rng.integers(1, 9)))]
    # A third of the conversations are equal, and one more third shares a long opening.
    rows += [(c, t, "u", f"same {t}") for c in range(1000, 2000) for t in range(3)]
    rows += [(c, t, "u", f"long {t}" if t < 40 else f"{c}") for c in range(3000, 3030) for t in range(40 + c % 3)]
    assert query_on(spark, rows, tmp_path) == trie(rebuilt(rows))


def test_messy_conversations(spark, tmp_path):
    rows = [
        (0, 0, "user", "hi"), (0, 1, None, None), (0, 2, "user", "ünï😀"), (0, None, "system", "s"),
        (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None),
        (7, 3, "", ""), (7, 3, None, ""), (7, 3, "", None),                      # repeated and tied turns
        (250, 0, "user", "no opener"), (-5, 0, "user", "below zero"), (-105, 1, "user", "below zero"),
        (None, 0, "user", "no conversation"), (None, None, None, None),
        (99, 0, "user", "w " * 200_000),
        (12, 0, "u:1", "a"), (13, 0, "u", ":1a"),
    ]
    rows += [(60, t, "user", str(t % 3)) for t in range(700)] + [(61, t, "user", str(t % 3)) for t in range(699)]
    assert query_on(spark, rows, tmp_path) == trie(rebuilt(rows))


def test_no_conversation(spark, tmp_path):
    assert query_on(spark, [], tmp_path) == []


def test_own_columns_and_turnless_conversations(spark):
    """Other column names and extra columns that clash with the operator's own."""
    df = spark.createDataFrame([(1, 0, "a", "x", 5, "n"), (2, 0, "a", "x", 5, "n"), (2, 1, "b", "yy", 5, "n")],
                               "c bigint, n bigint, who string, said string, depth int, node string")
    chains = turn_chains(df, "c", "n", "who", "said")
    assert nodes_of(prefix_trie(chains)) == trie({1: [("a", "x")], 2: [("a", "x"), ("b", "yy")]})
    none = shared_openings(chains, F.lit(77), F.lit(1))
    got = {r.conv_id: len(r.chain) // 20 for r in none.collect()}
    assert got == {1: 0, 2: 1}
    assert nodes_of(prefix_trie(none)) == trie({1: [], 2: [("b", "yy")]})
