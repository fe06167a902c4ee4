"""Operator 9: documents that hold benchmark passages, by spaced-seed hashing.

Fixed masks pick some of the tokens in a window and ignore the others, so a seed still matches
when an ignored token was substituted. Hashes of the masked windows of test items are looked up
for every window of every document; around each hit item and document are aligned and compared
token by token.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import mix, pieces, rolling, scratch, word_hashes

#: Some mask finds a stretch whose differing tokens come every five tokens or more, the densest that the score admits.
MASKS = ("110110110111", "111010011101", "101111000111", "111101111011")
MIN_MATCH = 12            # tokens that must agree (all of them in a shorter item)
MISMATCH_COST = 3         # agreeing tokens that make up for a differing one
BLOCK_TOKENS = 1_000_000  # test tokens that one pass over the documents looks up
CHAIN = 4                 # passes whose blocks executors hold at once; the documents are written after so many

_PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> bytes:
    """Lower-case UTF-8 with ASCII punctuation blanked."""
    return text.lower().encode("utf-8", "replace").translate(_PUNCTUATION) if isinstance(text, str) else b""


def masked(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the picked tokens of each window of the mask's width."""
    count = max(0, len(hashes) - len(mask) + 1)
    total = np.full(count, int(mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total *= _GOLDEN
            total += hashes[k:k + count]
            total ^= total >> np.uint64(29)
    return mix(total)


class SeedIndex:
    """Masked windows of a block of items; items below a mask's width count as one window."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        width = max(map(len, MASKS))
        self.items = items
        self.short = sorted({len(h) for _, h in items if 0 < len(h) < width})
        seeds, owners, places = [], [], []
        for k, (_, h) in enumerate(items):
            found = [masked(h, m) for m in MASKS] if len(h) >= width else [rolling(h, len(h))] if len(h) else []
            for s in found:
                seeds.append(s)
                owners.append(np.full(len(s), k, np.int32))
                places.append(np.arange(len(s), dtype=np.int32))
        seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(seeds, kind="stable")
        self.seeds = seeds[order]
        self.owners = np.concatenate(owners)[order] if len(seeds) else np.zeros(0, np.int32)
        self.places = np.concatenate(places)[order] if len(seeds) else np.zeros(0, np.int32)
        self.shift = np.uint64(64 - 22)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.seeds >> self.shift).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Distinct (begin of the item in the document, item) of all seeds that agree, as rows."""
        found = []
        for s in [masked(hashes, m) for m in MASKS] + [rolling(hashes, n) for n in self.short]:
            at = np.flatnonzero(self.seen[(s >> self.shift).astype(np.int64)])
            low = np.searchsorted(self.seeds, s[at], "left")
            count = np.searchsorted(self.seeds, s[at], "right") - low
            at, low, count = at[count > 0], low[count > 0], count[count > 0]
            if len(at):
                each = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                found.append(np.stack([np.repeat(at, count) - self.places[each], self.owners[each]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def overlap(document: np.ndarray, item: np.ndarray, begin: int) -> tuple[int, int, int]:
    """Agreeing tokens of the best aligned stretch, and its first and last position + 1."""
    low, high = max(0, begin), min(len(document), begin + len(item))
    same = document[low:high] == item[low - begin:high - begin]
    gain = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH_COST))])
    least = np.minimum.accumulate(gain)
    end = int(np.argmax(gain - least))
    start = int(np.flatnonzero(gain[:end + 1] == least[end])[-1])
    return int(same[start:end].sum()), low + start, low + end


def find_contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, contaminated, items, matched_tokens`` for every row of ``df``.

    A document is contaminated when a stretch aligned with an item has at least ``MIN_MATCH``
    agreeing tokens (every token of a shorter item), where each differing token takes away
    ``MISMATCH_COST``. ``items`` lists the ids of such items in order, ``matched_tokens`` the
    longest agreement. Items with a NULL id, a NULL text or no token match nothing; documents
    with a NULL or empty text are clean. Equal items are all listed. Repeated documents each get
    a row. The test set is looked up in blocks of ``BLOCK_TOKENS`` tokens: each block is
    one pass over the documents, which hands on the findings of the passes before with each row.
    """
    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                     F.expr("cast(array() as array<bigint>)").alias("items"), F.lit(0).cast("long").alias("matched_tokens"))
    found = f"doc_id {dict(base.dtypes)['doc_id']}, items array<bigint>, matched_tokens long"
    base = _through_blocks(base, benchmark, item_col, item_text_col, lambda df, index, last: df.mapInPandas(
        _scan(index, keep=not last), found if last else found + ", text string"))
    return base.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "matched_tokens")


def remove_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                        item_text_col: str = "text") -> DataFrame:
    """The rows and columns of ``df`` without documents that hold a passage of an item."""
    def scan(df: DataFrame, index, last: bool) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seeds = SeedIndex(index.value)
            for batch in batches:
                yield batch[[not found for found, _ in matches(batch[text_col], seeds)]]

        return df.mapInPandas(run, df.schema)

    return _through_blocks(df, benchmark, item_col, item_text_col, scan)


def _through_blocks(df: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, scan) -> DataFrame:
    """``df`` after ``scan(df, index, last)`` for each block of items.

    Blocks hold about ``BLOCK_TOKENS`` tokens. After ``CHAIN`` of them the rows are written and the
    blocks let go, so that driver and executors never hold more.
    """
    items = scratch(benchmark.select(F.col(item_col).cast("long").alias("item_id"),
                                     F.col(item_text_col).cast("string").alias("text"))
                    .filter("item_id IS NOT NULL AND text IS NOT NULL")
                    .mapInPandas(_tokens, "item_id long, tokens binary"), "items")
    total = items.agg(F.sum(F.length("tokens"))).first()[0] or 0
    blocks, held = max(1, -(-total // (8 * BLOCK_TOKENS))), []
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "tokens"), F.lit(blocks)) == block).collect()
        rows.sort(key=lambda r: (r.item_id, r.tokens))
        held.append(benchmark.sparkSession.sparkContext.broadcast(
            [(r.item_id, np.frombuffer(r.tokens, np.uint64)) for r in rows]))
        last = block == blocks - 1
        df = scan(df, held[-1], last)
        if len(held) == CHAIN and not last:
            df = scratch(df, "scanned")
            while held:
                held.pop().destroy()
    return df


def matches(texts, seeds: SeedIndex) -> Iterator[tuple[set[int], int]]:
    """For each text the ids of the items of which it holds a passage, and the longest agreement."""
    data = [plain(t) for t in texts]
    for begin, end in pieces(data):
        hashes, at = word_hashes(data[begin:end])
        for b, e in zip(at[:-1], at[1:]):
            found, best = set(), 0
            for start, k in seeds.hits(hashes[b:e]):
                item_id, item = seeds.items[k]
                same, _, _ = overlap(hashes[b:e], item, int(start))
                if same >= min(MIN_MATCH, len(item)):
                    found.add(item_id)
                    best = max(best, same)
            yield found, best


def _scan(index, keep: bool):
    """Add the findings of a block to those of the blocks before; the text is kept for the next one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = SeedIndex(index.value)
        for batch in batches:
            found = list(matches(batch["text"], seeds))
            out = batch if keep else batch.drop(columns="text")
            yield out.assign(items=[sorted({*x, *before}) for (x, _), before in zip(found, batch["items"])],
                             matched_tokens=[max(n, before) for (_, n), before in zip(found, batch["matched_tokens"])])

    return run


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        data = [plain(t) for t in batch["text"]]
        yield pd.DataFrame({"item_id": batch["item_id"], "tokens": [word_hashes([d])[0].tobytes() for d in data]})
