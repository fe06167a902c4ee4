"""Operator 11: resampling towards a target distribution, with each distinct line looked at once.

Documents are weighted by hashed n-gram features: how much likelier a feature's bucket is in the
target texts than in the documents. A word never spans a newline, so the features of a text are
those inside its lines and those that cross a line's end:

* Lines. Distinct lines are counted over all documents. The features of each are hashed once and
  kept as a sorted, delta-coded list of buckets; its counts enter the totals multiplied by its
  occurrences, and its weight is summed once and joined to every document that holds it.
* Crossings. Runs of words with a line's end inside are hashed where the text is read, and added
  to the totals and to the document.

Documents are drawn without replacement, by adding Gumbel noise from a hash of the id to the weight and
taking the highest sums.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import scratch
from plumbline.operators.ordering import with_row_numbers

BUCKETS = 10_000
CHUNK_WORDS = 200_000  # words whose features are held at once
VOCABULARY = 300_000   # words whose checksums a task remembers
SHIFTS = 256           # lengths in bytes with a table; longer words are hashed one by one

# A word is a run of 0-9, a-z and of what is not ASCII; A-Z count as a-z.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _shift_tables() -> np.ndarray:
    """``t[n, k, b]``: what byte k (of value b) of a checksum becomes when n more bytes follow.

    The CRC-32 of ``x + y`` is that of ``x``, moved on by the length of ``y``, xor that of ``y``.
    """
    tables = np.zeros((SHIFTS, 4, 256), np.uint32)
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, SHIFTS):
        last = tables[n - 1]
        tables[n] = one[last & 255] ^ (last >> 8)
    return tables


class Checksums:
    """CRC-32 of runs of words, from the checksums of the words."""

    def __init__(self):
        self.tables = _shift_tables()
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.alone, self.after, self.length = [], [], []  # of the word, of a space and the word, its bytes with the space
        self.words: list[bytes] = []

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > VOCABULARY:
            self.forget()
        known = self.known
        for w in set(words).difference(known):
            known[w] = len(self.words)
            self.words.append(w)
            self.alone.append(zlib.crc32(w))
            self.after.append(zlib.crc32(b" " + w))
            self.length.append(len(w) + 1)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def joined(self, left: np.ndarray, right: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Checksums of runs ``left`` with one more word ``right`` behind a space."""
        n = length[right]
        t = self.tables
        short = np.minimum(n, SHIFTS - 1)
        out = t[short, 0, left & 255] ^ t[short, 1, left >> 8 & 255] ^ t[short, 2, left >> 16 & 255] ^ t[short, 3, left >> 24]
        out ^= after[right]
        for k in np.flatnonzero(n >= SHIFTS):
            out[k] = zlib.crc32(b" " + self.words[right[k]], int(left[k]))
        return out

    def runs(self, words: list[bytes]) -> list[np.ndarray]:
        """Buckets of the runs of one, two and three words, by their first word."""
        w = self.numbers(words)
        alone, after, length = (np.array(x, d) for x, d in ((self.alone, np.uint32), (self.after, np.uint32), (self.length, np.int64)))
        one = alone[w] if len(w) else np.zeros(0, np.uint32)
        two = self.joined(one[:-1], w[1:], after, length) if len(w) > 1 else one[:0]
        three = self.joined(two[:-1], w[2:], after, length) if len(w) > 2 else one[:0]
        return [(x % np.uint32(BUCKETS)).astype(np.int64) for x in (one, two, three)]


def packed(buckets: np.ndarray, owner: np.ndarray, owners: int) -> list[bytes]:
    """For each owner its buckets, sorted, as steps of one byte; 255 stands for itself and no end."""
    order = np.lexsort((buckets, owner))
    buckets, owner = buckets[order], owner[order]
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    steps = np.where(first, buckets, np.diff(buckets, prepend=0))
    sizes = steps // 255 + 1
    data = np.full(int(sizes.sum()), 255, np.uint8)
    ends = np.cumsum(sizes)
    data[ends - 1] = steps % 255
    at = np.concatenate([[0], ends])[np.searchsorted(owner, np.arange(owners + 1))]
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:])]


def unpacked(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of ``packed`` lists, and where each list begins and ends among them."""
    data = np.frombuffer(b"".join(lists), np.uint8)
    at = np.cumsum([0, *map(len, lists)])
    total = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
    ends = data != 255
    base = np.repeat(total[at[:-1]], np.diff(at))
    return (total[1:] - base)[ends], np.concatenate([[0], np.cumsum(ends)])[at]


def sums_of(lists: list[bytes], gains: np.ndarray) -> np.ndarray:
    buckets, at = unpacked(lists)
    total = np.concatenate([[0], np.cumsum(gains[buckets])])
    return total[at[1:]] - total[at[:-1]]


def _parts(batches: Iterator[list], size) -> Iterator[list]:
    """Items in lists whose sizes add up to about a chunk of words (a word has some six bytes)."""
    held, total = [], 0
    for batch in batches:
        for item in batch:
            held.append(item)
            total += size(item)
            if total >= 6 * CHUNK_WORDS:
                yield held
                held, total = [], 0
    if held:
        yield held


def _counts(seen: np.ndarray, columns: list[str]) -> pd.DataFrame:
    at = np.flatnonzero(seen)
    known = {"kind": np.ones(len(at), np.int32), "bucket": at.astype(np.int32), "n": seen[at]}
    return pd.DataFrame({c: known[c] if c in known else pd.Series([None] * len(at), dtype=object) for c in columns})


def line_key(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


_LINES = "kind int, bucket int, n long, line binary, features binary"
_ROWS = "kind int, bucket int, n long, doc_id string, n_words long, crossing binary, lines array<binary>"


def _line_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each distinct line its features; at the end of a task the totals, times the occurrences."""
    sums, seen = Checksums(), np.zeros(BUCKETS, np.int64)
    names = ["kind", "bucket", "n", "line", "features"]
    for part in _parts((list(zip(b["line"], b["occurrences"])) for b in batches), lambda x: len(x[0])):
        keys, words, sizes, times = [], [], [], []
        for line, occurrences in part:
            raw = line.encode("utf-8", "replace")
            found = raw.translate(_PLAIN).split()
            if found:
                keys.append(line_key(raw))
                words += found
                sizes.append(len(found))
                times.append(occurrences)
        if not keys:
            continue
        line_of, times = np.repeat(np.arange(len(keys)), sizes), np.array(times, np.int64)
        buckets, owners = [], []
        for k, found in enumerate(sums.runs(words)):
            inside = line_of[:len(found)] == line_of[k:]
            buckets.append(found[inside])
            owners.append(line_of[:len(found)][inside])
        buckets, owners = np.concatenate(buckets), np.concatenate(owners)
        np.add.at(seen, buckets, times[owners])
        yield pd.DataFrame({"kind": np.zeros(len(keys), np.int32), "bucket": np.zeros(len(keys), np.int32), "n": times,
                            "line": keys, "features": packed(buckets, owners, len(keys))}, columns=names)
    yield _counts(seen, names)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each document its words, lines and crossing features; at the end of a task their totals."""
    sums, seen = Checksums(), np.zeros(BUCKETS, np.int64)
    names = ["kind", "bucket", "n", "doc_id", "n_words", "crossing", "lines"]
    for part in _parts((list(zip(b["doc_id"], b["text"])) for b in batches), lambda x: len(x[1]) if x[1] else 0):
        totals, lines, edges, places = [], [], [], []
        for k, (_, text) in enumerate(part):
            keys, total = [], 0
            for number, raw in enumerate((text or "").encode("utf-8", "replace").split(b"\n")):
                if found := raw.translate(_PLAIN).split():
                    keys.append(line_key(raw))
                    # Only two words at either end of a line are in runs that cross its ends.
                    for at in range(len(found)) if len(found) <= 4 else (0, 1, len(found) - 2, len(found) - 1):
                        edges.append(found[at])
                        places.append((k, number, total + at))
                    total += len(found)
            totals.append(total)
            lines.append(keys)
        doc, line, at = np.array(places, np.int64).reshape(-1, 3).T
        buckets, owners = [], []
        for k, found in enumerate(sums.runs(edges)):
            n = len(found)
            across = (doc[:n] == doc[k:]) & (at[k:] - at[:n] == k) & (line[:n] != line[k:])
            buckets.append(found[across])
            owners.append(doc[:n][across])
        buckets, owners = np.concatenate(buckets), np.concatenate(owners)
        seen += np.bincount(buckets, minlength=BUCKETS)
        yield pd.DataFrame({"kind": np.zeros(len(part), np.int32), "bucket": np.zeros(len(part), np.int32), "n": np.zeros(len(part), np.int64),
                            "doc_id": [d for d, _ in part], "n_words": totals, "crossing": packed(buckets, owners, len(part)),
                            "lines": lines}, columns=names)
    yield _counts(seen, names)


def features_of(df: DataFrame, id_col: str | None, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct lines with their features, rows with theirs, and ``bucket, n``: features of all texts by bucket."""
    text = F.col(text_col).cast("string")
    lines = df.select(F.explode(F.split(text, "\n")).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("occurrences"))
    lines = scratch(lines.mapInPandas(_line_features, _LINES), "lines")
    doc_id = F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")
    rows = df.select(doc_id.alias("doc_id"), text.alias("text")).mapInPandas(_rows, _ROWS)
    rows = scratch(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = lines.filter("kind = 1").select("bucket", "n").unionByName(rows.filter("kind = 1").select("bucket", "n"))
    return (lines.filter("kind = 0").select("line", "n", "features"),
            rows.filter("kind = 0").select("row", "doc_id", "n_words", "crossing", "lines"),
            found.groupBy("bucket").agg(F.sum("n").alias("n")))


def gains_of(seen: DataFrame, wanted: DataFrame) -> np.ndarray:
    """Thousandths of the log-likelihood ratio of each bucket, with one feature more in every bucket; ``BUCKETS`` numbers."""
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for counts, table in ((s, seen), (t, wanted)):
        for r in table.collect():
            counts[r.bucket] = r.n
    s_all, t_all = float(s.sum() + BUCKETS), float(t.sum() + BUCKETS)
    ratios = (t + 1).astype(float) * s_all / ((s + 1).astype(float) * t_all)
    return np.array([math.floor(1000.0 * math.log(x)) for x in ratios.tolist()], np.int64)


def _weights(gains: np.ndarray, column: str, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keep].copy()
            parts = []
            for begin in range(0, len(batch), 500):
                parts.append(sums_of(batch[column].iloc[begin:begin + 500].tolist(), gains))
            out["weight"] = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield out

    return run


def noise(id_text: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel variate, from 32 bits of the SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample_towards(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     target_col: str = "text", percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for every row of ``df``.

    Of the N rows with at least ``min_words`` words the floor(percent N / 100) highest scores are drawn and
    ranked from 1, equal scores by smaller id (NULL last, which is hashed as an empty id); other rows
    have no rank. A NULL or empty text, or one without words, has no features and the weight 0. Equal
    texts have equal weights; rows that repeat an id are drawn each on their own. Further columns are
    ignored. Without target texts the weights prefer features that are rare in ``df``; an empty
    table gives an empty table.

    The line counts move each line once; the driver holds one number for each of the ``BUCKETS`` buckets.
    """
    lines, rows, seen = features_of(df, id_col, text_col)
    wanted = features_of(target, None, target_col)[2]
    gains = gains_of(seen, wanted)
    weighed = lines.select("line", "features").mapInPandas(_weights(gains, "features", ["line"]), "line binary, weight long")
    own = rows.drop("lines").mapInPandas(
        _weights(gains, "crossing", ["row", "doc_id", "n_words"]), "row long, doc_id string, n_words long, weight long")
    held = rows.select("row", F.explode("lines").alias("line")).join(weighed, "line").select(
        "row", F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("long").alias("n_words"), "weight")
    doc = own.unionByName(held).groupBy("row").agg(
        F.max("doc_id").cast("long").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("weight").alias("weight"))
    n_features = F.greatest(F.lit(3) * F.col("n_words") - 3, F.least("n_words", F.lit(1)))
    scored = scratch(doc.select("row", "doc_id", "n_words", n_features.cast("long").alias("n_features"), "weight",
                                (F.col("weight") + noise(F.col("doc_id").cast("string"), seed)).alias("score")), "scored")
    fit = scored.filter(F.col("n_words") >= min_words)
    drawn = percent * fit.count() // 100
    ordered = with_row_numbers(fit.select("row", "doc_id", (-F.col("score")).alias("from_top")), ["from_top", "doc_id", "row"], "rank",
                               ranges=int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranks = ordered.filter(F.col("rank") <= drawn).select("row", "rank")
    return scored.join(ranks, "row", "left").drop("row")
