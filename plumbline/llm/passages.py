"""Operator 6: passages that repeat across documents, by compact windows of token min-hashes.

The tokens are 5-word shingles. The Cartesian tree over the token hashes has a node for every token
that is the least of some stretch; the stretch between its smaller neighbours is its compact window.
Windows of two texts that are alike have a run of tokens in common, in order, whose length follows
from the asked likeness (``run_lengths``). The nodes whose compact windows are that wide hold the
least of every run, so the joined nodes propose every like pair of windows.

In each bucket every text is compared with the one of the least id, if the tokens beside the node
allow it; texts whose node lies in no passage found are compared with all of the bucket that can be
alike by the rarest tokens around the node, unless both have the sets of tokens there in common with
others. The windows around each hit are verified token by token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import ascii_lower, discard, mix, mix_in_place, pieces, rolling, semi_join_ids, signed, texts_of, word_hashes
from plumbline.llm.shared import scratch_tidy as scratch

SHINGLE = 5
MIN_WORDS = 50
PERCENT = 75
COUNTERS = 1 << 20  # of the tokens of all texts, by their first bits; they only steer the order
SLICE = 1 << 14  # counters that are added together
SHARE = 4_000  # a token counts as frequent from 4 of so many texts on

_ODD = mix(np.arange(11, 12, dtype=np.uint64)) | np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` tokens (the first of equals), by doubling steps."""
    least, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = least[:-step], least[step:]
        least, reach = np.where(values[b] < values[a], b, a), reach + step
    return least


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (left, least, right) of the Cartesian tree whose stretch is ``width`` wide or more.

    A token is such a node when it is the least of some ``width`` tokens (the first of equals).
    Its stretch is found by doubling steps over the minima of 1, 2, 4, ... tokens.
    """
    n = len(values)
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    nodes = np.unique(least_places(values, width))
    minima, size = [values], 1
    while 2 * size <= n:
        minima.append(np.minimum(minima[-1][:-size], minima[-1][size:]))
        size *= 2
    left, right, own = nodes.copy(), nodes.copy(), values[nodes]
    for level in range(len(minima) - 1, -1, -1):
        size, low = 1 << level, minima[level]
        # Left of a node everything is greater, right of it greater or equal.
        at = left - size
        ok = at >= 0
        ok[ok] = low[at[ok]] > own[ok]
        left[ok] -= size
        at = right + 1
        ok = at + size <= n
        ok[ok] = low[at[ok]] >= own[ok]
        right[ok] += size
    return left, nodes, right


def _words_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of about a piece of texts, one after the other, and where each text begins."""
    data = [ascii_lower(t) for t in texts]
    for begin, end in pieces(data):
        yield word_hashes(data[begin:end])


def _classes(words: np.ndarray, at: np.ndarray) -> list[int]:
    """Class of the word sequence of each text."""
    return signed(np.array([xxhash.xxh3_64_intdigest(words[b:e].tobytes()) for b, e in zip(at[:-1], at[1:])], np.uint64)).tolist()


def token_arrays(texts: list[str | None]) -> Iterator[tuple[np.ndarray, int, int]]:
    """Shingle hashes by position, class of the word sequence and words of each text."""
    for words, at in _words_of(texts):
        for c, b, e in zip(_classes(words, at), at[:-1], at[1:]):
            yield rolling(words[b:e], SHINGLE), c, int(e - b)


def _counters(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _holding(words: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """How many of the chosen texts hold a token of each counter."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:max(0, len(words) - SHINGLE + 1)]
    ok = (np.arange(len(text)) + SHINGLE <= at[1:][text]) & chosen[text]
    held = np.sort(text[ok] * COUNTERS + _counters(rolling(words, SHINGLE))[ok])
    return np.bincount(held[np.flatnonzero(np.diff(held, prepend=-1))] % COUNTERS, minlength=COUNTERS)


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Class and size of each text, and at the end rows of how many distinct texts hold each token."""
    seen, counts = set(), np.zeros(COUNTERS, np.int64)
    for batch in batches:
        classes, sizes = [], []
        for words, at in _words_of(batch["text"].tolist()):
            own = _classes(words, at)
            new = [c not in seen and not seen.add(c) for c in own]
            counts += _holding(words, at, np.array(new, bool))
            classes += own
            sizes += np.diff(at).tolist()
        yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "class_id": classes, "n_words": sizes,
                            "slice": None, "counts": None})
    rows = [(k, part.astype(np.min_scalar_type(part.max()))) for k, part in enumerate(counts.reshape(-1, SLICE)) if part.any()]
    yield pd.DataFrame({"doc_id": None, "text_hash": None, "class_id": None, "n_words": None, "slice": [k for k, _ in rows],
                        "counts": [part.tobytes() for _, part in rows]})


def run_lengths(width: int, percent: int) -> tuple[int, int, int, int]:
    """Tokens of the run that two like windows have in common, in order, by what both repeat.

    Let one of the windows repeat no run of four words. Then tokens of the other that it holds too,
    side by side, are side by side in it. A gap between two such runs has three tokens at least if
    it repeats no two words, two if no three words, else one, and the gaps together are the tokens
    that the other has for itself. Windows that both repeat four words have one token in common.
    """
    sizes = range(-(-percent * width // 100), width + 1)
    wanted = [-(-percent * (width + size) // (100 + percent)) for size in sizes]
    return (*(max(1, min(-(-n // (1 + (width - n) // gap)) for n in wanted)) for gap in (3, 2, 1)), 1)


def _covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places are in one of the intervals, ends exclusive."""
    begin = np.minimum(np.maximum(begin, 0), n)
    end = np.maximum(begin, np.minimum(end, n))
    return np.cumsum(np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0


def _repeating(words: np.ndarray, n_words: int, size: int, text: np.ndarray, first: np.ndarray,
               some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of ``n_words`` words repeat a run of ``size`` words, and the places of such runs.

    ``text`` is the text of each word, ``first`` where that text begins. Only runs at the places
    ``some`` are looked at.
    """
    runs = rolling(words, size)[some]
    order = np.argsort(runs, kind="stable")
    runs, places = runs[order], some[order]
    same = np.flatnonzero((runs[1:] == runs[:-1]) & (text[places[1:]] == text[places[:-1]]))
    a, b = places[same], places[same + 1]
    return (_covered(np.maximum(b - (n_words - size), first[b]), a + 1, max(0, len(words) - n_words + 1)),
            np.unique(np.concatenate([a, b])))


def key_places(tokens: np.ndarray, words: np.ndarray, values: np.ndarray, width: int, percent: int, at: np.ndarray | None = None) -> np.ndarray:
    """Places of the nodes whose compact windows are as wide as the run that like windows share.

    The words may be those of several texts, which begin at ``at`` (the end comes last). Tokens that
    reach into the next text count for nothing.
    """
    return _key_places(tokens, words, values, width, percent, at)[0]


def _key_places(tokens: np.ndarray, words: np.ndarray, values: np.ndarray, width: int, percent: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``key_places``, and which places lie in a window that repeats three words."""
    n, n_words = len(words), width + SHINGLE - 1
    at = np.array([0, n]) if at is None else at
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first, last = at[:-1][text], at[1:][text]
    room = last - np.arange(n)
    chosen, loose, some = np.zeros(n, bool), np.zeros(n, bool), np.arange(n)
    for length, size in zip(run_lengths(width, percent), (0, 2, 3, 4)):
        if len(tokens) < length:
            break
        least = least_places(values, length)
        ok = room[:len(least)] >= length + SHINGLE - 1
        if size:
            windows, some = _repeating(words, n_words, size, text, first, some[room[some] >= size])
            starts = np.flatnonzero(windows & (room[:len(windows)] >= n_words))
            if not len(starts):
                break
            if size == 3:
                loose = _covered(starts, starts + width, n)
            ok &= _covered(starts, starts + width - length + 1, len(least))
        chosen[least[ok]] = True
    places = np.flatnonzero(chosen)
    return places, loose[places]


def _sides(words: np.ndarray, at: np.ndarray, places: np.ndarray, text: np.ndarray, loose: np.ndarray, width: int, percent: int) -> np.ndarray:
    """Hashes of the tokens before and after each place, 31 and 32 bits, and in between whether it is ``loose``.

    A run that like windows share goes so far to one side of its least token if one of them repeats
    no three words. Where the text ends before, the hash is of the place.
    """
    reach = run_lengths(width, percent)[1] // 2
    own, sides = mix(words[places] + places.astype(np.uint64)), []
    runs = rolling(words, SHINGLE - 1 + reach)
    for begin, ok in ((places - reach, places - reach >= at[:-1][text]), (places + 1, places + SHINGLE + reach <= at[1:][text])):
        sides.append(np.where(ok, runs[np.where(ok, begin, 0)], own) >> np.uint64(32) if len(runs) else own >> np.uint64(32))
    return (sides[0] & ~np.uint64(1) | (loose | (reach == 0)).astype(np.uint64)) << np.uint64(32) | sides[1]


def _order(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Hashes of the tokens, those of frequent ones higher, so that a node is the rarest of a stretch."""
    return mix(tokens * _ODD) >> np.uint64(6) | levels[_counters(tokens)].astype(np.uint64) << np.uint64(58)


def _keys(width: int, percent: int, levels: np.ndarray, buckets: int):
    """Rows of the keys (token, class, id of the text, place) of many texts by a bucket of the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            ids, begin = batch.column(0), 0
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for words, at in _words_of(batch.column(1).to_pylist()):
                of = np.flatnonzero(np.diff(at) >= width + SHINGLE - 1)
                if len(of):
                    classes = np.array(_classes(words, at), np.int64)[of]
                    some, end = (np.concatenate([words[at[k]:at[k + 1]] for k in of]), np.cumsum([0, *(at[k + 1] - at[k] for k in of)]))
                    parts.append(_places(some, end, classes, ids[begin + of], named[begin + of]))
                    size += len(parts[-1][0])
                begin += len(at) - 1
            if size > 400_000:
                yield _blocks(parts, buckets)
                parts, size = [], 0
        if parts:
            yield _blocks(parts, buckets)

    def _places(words, at, *of_text):
        tokens = rolling(words, SHINGLE)
        places, loose = _key_places(tokens, words, _order(tokens, levels), width, percent, at)
        text = np.searchsorted(at, places, "right") - 1
        return tokens[places], *(x[text] for x in of_text), (places - at[text]).astype(np.int32), _sides(words, at, places, text, loose, width, percent)

    return run


_COLUMNS = {"tokens": np.uint64, "classes": np.int64, "ids": np.int64, "named": bool, "places": np.int32, "sides": np.uint64}
_BLOCK = ", ".join(["bucket int", *(f"{name} binary" for name in _COLUMNS)])


def _blocks(parts: list[tuple], buckets: int) -> pa.RecordBatch:
    """Arrays of hash, class, id, whether there is one, place and ``_sides``, cut by a bucket of the hash."""
    arrays = [np.concatenate(x) for x in zip(*parts)]
    bucket = (arrays[0] % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    ends = [*first[1:].tolist(), len(order)]
    columns = [pa.array([x[b:e].tobytes() for b, e in zip(first.tolist(), ends)], pa.binary()) for x in (a[order] for a in arrays)]
    return pa.RecordBatch.from_arrays([pa.array(found), *columns], names=["bucket", *_COLUMNS])


class Shared:
    """Rows of one bucket whose hash several classes hold: by hash, class and place, each once.

    A group is a hash in a class, a set is a hash; ``rank`` has the groups of each set, the least id
    first. A group is ``alone`` if no row of another class meets one of its rows on a side and none
    is loose as one of its own: then nothing is alike around it. Such come last.
    """

    def __init__(self, block: pa.Table):
        tokens, *rest = (np.concatenate([np.frombuffer(x, kind) for x in block.column(n).to_pylist()] or [np.zeros(0, kind)])
                         for n, kind in _COLUMNS.items())
        order = np.argsort(tokens)
        same = tokens[order[1:]] == tokens[order[:-1]]
        order = order[(np.concatenate([same, [False]]) | np.concatenate([[False], same]))[:len(order)]]
        tokens, classes, ids, named, places, sides = (x[order] for x in (tokens, *rest))
        met = self._met(tokens, classes, sides >> np.uint64(33)) | self._met(tokens, classes, sides & np.uint64(0xFFFFFFFF))
        loose = (sides >> np.uint64(32) & np.uint64(1)).astype(bool)
        met[loose] |= self._met(tokens[loose], classes[loose], sides[loose] * np.uint64(0))
        keep = self._met(tokens, classes, sides * np.uint64(0))
        order = np.flatnonzero(keep)
        order = order[np.lexsort((ids[order], ~named[order], places[order], classes[order], tokens[order]))]
        tokens, classes, ids, named, places, sides, met = (x[order] for x in (tokens, classes, ids, named, places, sides, met))
        new = self._breaks(tokens)
        group = new | self._breaks(classes)
        keep = group | self._breaks(places)
        tokens, classes, ids, named, self.places, self.sides, met, new, group = (
            x[keep] for x in (tokens, classes, ids, named, places, sides, met, new, group))
        self.at = np.flatnonzero(group)  # where each group begins
        self.ends = np.append(self.at[1:], len(group))
        self.token, self.class_id, self.named, new = tokens[self.at], classes[self.at], named[self.at], new[self.at]
        self.id, self.alone = ids[self.at], ~met[self.at]
        if len(self.at):  # the places of a group are one text's or those of its copies, the least id counts
            self.alone = ~np.logical_or.reduceat(met, self.at)
            self.id = np.minimum.reduceat(np.where(named, ids, np.iinfo(np.int64).max), self.at)
        self.first = np.flatnonzero(new)  # of the groups of each set
        self.sizes = np.diff(self.first, append=len(new))
        self.set = np.repeat(np.arange(len(self.first)), self.sizes)
        self.rank = np.lexsort((self.class_id, self.id, ~self.named, self.alone, self.set))

    @staticmethod
    def _breaks(values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]])

    @staticmethod
    def _met(tokens: np.ndarray, classes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Which rows share token and value with a row of another class."""
        order = np.lexsort((classes, values, tokens))
        new = Shared._breaks(tokens[order]) | Shared._breaks(values[order])
        first = np.flatnonzero(new)
        met = np.zeros(len(order), bool)
        if len(first):
            several = np.add.reduceat((new | Shared._breaks(classes[order])).astype(np.int64), first) > 1
            met[order] = np.repeat(several, np.diff(first, append=len(new)))
        return met

    def lists(self, groups: np.ndarray, chosen: np.ndarray) -> pa.ListArray:
        """The places of groups; of those not chosen none."""
        sizes = np.where(chosen, self.ends[groups] - self.at[groups], 0)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        some = np.repeat(self.at[groups] - offsets[:-1], sizes) + np.arange(offsets[-1])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(self.places[some].astype(np.int32)))


_MEMBERS = "token long, class_id long, places array<int>, head long, head_places array<int>, met boolean, alone boolean, size int"


def _members(block: pa.Table) -> pa.Table:
    """The classes that hold a token, with the one of the least id, their head, and whether they can be alike around it."""
    x = Shared(block)
    head, every = x.rank[x.first][x.set], np.arange(len(x.at))
    own, other = x.sides[x.at], x.sides[x.at[head]]
    apart = (own >> np.uint64(33) != other >> np.uint64(33)) & ((own ^ other) & np.uint64(0xFFFFFFFF) > 0) & ((own & other) >> np.uint64(32) & np.uint64(1) == 0)
    met = (head != every) & ~x.alone & ~(apart & (x.ends - x.at == 1) & (x.ends - x.at == 1)[head])
    return pa.table([pa.array(signed(x.token)), pa.array(x.class_id), x.lists(every, every >= 0), pa.array(x.class_id[head]),
                     x.lists(head, head != every), pa.array(met), pa.array(x.alone), pa.array(x.sizes[x.set].astype(np.int32))],
                    names=["token", "class_id", "places", "head", "head_places", "met", "alone", "size"])


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch["slice"].tolist(), batch["counts"]):
            counts = np.frombuffer(counts, f"u{len(counts) // SLICE}")
            total[k] = total[k] + counts if k in total else counts.astype(np.int64)
    yield pd.DataFrame({"slice": list(total), "counts": [c.tobytes() for c in total.values()]})


def _frequent(counted: DataFrame, rows: int) -> np.ndarray:
    """Levels of the counters by how many of all texts hold their tokens, beyond what the median counter has."""
    total = np.zeros((COUNTERS // SLICE, SLICE), np.int64)
    parts = counted.select("slice", "counts").repartition(8, "slice").mapInPandas(_summed, "slice int, counts binary").collect()
    for r in parts:
        total[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    total = total.ravel()
    share = (total - np.median(total)) / max(1, rows / SHARE)
    return np.where(share >= 4, np.minimum(63, 2 * np.log2(np.maximum(1, share))), 0).astype(np.uint8)


def _packed(width: int):
    """Rows of what lies within a window of a text's places, and where each stretch begins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for (tokens, c, _), places in zip(token_arrays(batch["text"].tolist()), batch["places"]):
                at = np.unique(np.asarray(places, np.int64))
                breaks = np.flatnonzero(np.diff(at) >= 2 * width)
                begin = np.maximum(0, at[np.concatenate([[0], breaks + 1])] - width + 1)
                end = np.minimum(len(tokens), at[np.concatenate([breaks, [len(at) - 1]])] + width)
                offset = np.concatenate([[0], np.cumsum(end - begin)[:-1]])
                rows.append((c, np.concatenate([tokens[b:e] for b, e in zip(begin, end)]).tobytes(),
                             begin.astype(np.int32).tobytes(), offset.astype(np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["class_id", "tokens", "begin", "offset"])

    return run


class Packed:
    """A text of which only the stretches around its keys are kept, side by side."""

    def __init__(self, tokens: bytes, begin: bytes, offset: bytes, width: int):
        self.tokens = np.frombuffer(tokens, np.uint64)
        self.begin, self.offset = (np.frombuffer(b, np.int32).astype(np.int64) for b in (begin, offset))
        self.sorted = np.sort(self.tokens)
        self.repeats = bool((self.sorted[1:] == self.sorted[:-1]).any())
        n = max(0, len(self.tokens) - width + 1)
        self.size = distinct_counts(self.tokens, width) if self.repeats else np.full(n, width)
        # Windows that lie in one stretch.
        self.whole = ~_covered(self.offset[1:] - width + 1, self.offset[1:], n) if len(self.offset) > 1 else np.ones(n, bool)
        self.width, self._sums = width, None

    def among(self, other: Packed) -> np.ndarray:
        """Which tokens the other text holds too."""
        at = np.minimum(np.searchsorted(other.sorted, self.tokens), len(other.sorted) - 1)
        return other.sorted[at] == self.tokens

    def surroundings(self, places: np.ndarray) -> np.ndarray:
        """Hash of what stands within a window of each place."""
        if self._sums is None:
            none = np.zeros(self.width, np.uint64)
            around = np.concatenate([none, self.tokens, none])
            up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(around), by)])) for by in (_BASE, _INVERSE))
            self._sums = np.concatenate([none[:1], np.cumsum(around * up[:-1])]), down
        sums, down = self._sums
        return mix((sums[places + 2 * self.width] - sums[places + 1]) * down[places + 1])

    def inside(self, places: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.begin, places, "right") - 1
        return places - self.begin[at] + self.offset[at]

    def outside(self, places: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.offset, places, "right") - 1
        return places - self.offset[at] + self.begin[at]


def _firsts(tokens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last of the windows in which each token is the first of its kind."""
    n, at = len(tokens) - width + 1, np.arange(len(tokens))
    order = np.argsort(tokens, kind="stable")
    before = np.full(len(tokens), -1)
    same = np.flatnonzero(tokens[order[1:]] == tokens[order[:-1]])
    before[order[same + 1]] = order[same]
    return np.maximum(before + 1, at - width + 1), np.minimum(at, n - 1)


def set_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of the set of the tokens of each window."""
    n = len(tokens) - width + 1
    begin, end = _firsts(tokens, width)
    ok, total = begin <= end, np.zeros(n + 1, np.uint64)
    own = mix(tokens[ok] * _ODD)
    np.add.at(total, begin[ok], own)
    np.subtract.at(total, end[ok] + 1, own)
    return mix(np.cumsum(total)[:n])


def distinct_counts(tokens: np.ndarray, width: int, chosen: np.ndarray | None = None) -> np.ndarray:
    """Distinct (chosen) tokens of each window."""
    n = len(tokens) - width + 1
    begin, end = _firsts(tokens, width)
    ok = begin <= end if chosen is None else (begin <= end) & chosen
    return np.cumsum(np.bincount(begin[ok], minlength=n + 1) - np.bincount(end[ok] + 1, minlength=n + 1))[:n]


class Windows:
    """Windows of two texts that are alike by the sets of their tokens, wherever tokens were added or left out."""

    def __init__(self, x: np.ndarray, y: np.ndarray, width: int, percent: int, sizes: tuple[np.ndarray, np.ndarray] | None = None):
        self.x, self.y, self.width, self.percent = x, y, width, percent
        self.size_x, self.size_y = sizes or (distinct_counts(x, width), distinct_counts(y, width))

    def pairs(self, first: int, last: int, first_y: int, last_y: int) -> np.ndarray | None:
        """Which windows of x (rows) and y (columns) that begin within the given runs are alike; none: None."""
        width, percent = self.width, self.percent
        xs, ys = self.x[first:last + width], self.y[first_y:last_y + width]
        size_x, size_y = self.size_x[first:last + 1], self.size_y[first_y:last_y + 1]
        held_y = np.sort(ys)
        common = np.sort(xs[held_y[np.minimum(np.searchsorted(held_y, xs), len(ys) - 1)] == xs])
        common = common[np.concatenate([[True], common[1:] != common[:-1]])] if len(common) else common
        if not len(common) or (100 + percent) * len(common) < percent * (size_x.min() + size_y.min()):
            return None
        held = []
        for tokens in (xs, ys):
            at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
            places = np.flatnonzero(common[at] == tokens)
            total = np.zeros((len(tokens) + 1, len(common)), np.int32)
            total[places + 1, at[places]] = 1
            np.cumsum(total, axis=0, out=total)
            held.append((total[width:] > total[:-width]).astype(np.float32))
        ok = (100 + percent) * (held[0] @ held[1].T) >= percent * (size_x[:, None] + size_y[None, :])
        return ok if ok.any() else None

    def alike(self, first: int, last: int, first_y: int, last_y: int) -> tuple[int, int, int, int] | None:
        """Stretches of x and y that the like pairs cover of windows which begin within the given runs."""
        ok = self.pairs(first, last, first_y, last_y)
        if ok is None:
            return None
        # The runs are no longer than a window, so the windows of each side overlap.
        i, j = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
        return int(first + i[0]), int(first + i[-1]) + self.width, int(first_y + j[0]), int(first_y + j[-1]) + self.width


def _spread(windows: np.ndarray, width: int) -> np.ndarray:
    """Which places are in one of the windows."""
    starts = np.flatnonzero(windows)
    return _covered(starts, starts + width, len(windows) + width - 1)


def _stretches(starts: np.ndarray, width: int) -> np.ndarray:
    """(start, end) of what the windows cover that begin at the sorted places."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    breaks = np.flatnonzero(np.diff(starts) > width)
    return np.stack([starts[np.concatenate([[0], breaks + 1])], starts[np.concatenate([breaks, [len(starts) - 1]])] + width], axis=1)


class Comparison:
    """Stretches of two packed texts that like windows around shared places cover.

    Windows at the same distance are compared first, by the tokens equal place by place. What no
    such pair covers around a hit (tokens were added, left out or moved) is compared as sets: all
    windows that hold the one place with all that hold the other.
    """

    def __init__(self, x: Packed, y: Packed, width: int, percent: int):
        self.x, self.y, self.width, self.percent = x, y, width, percent
        self.in_x, self.in_y = np.zeros(len(x.tokens), bool), np.zeros(len(y.tokens), bool)
        self.tried: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def may(self) -> bool:
        """Whether any window of each text has the asked share of its tokens in the other; marks those."""
        width, marks = self.width, []
        for x, y in ((self.x, self.y), (self.y, self.x)):
            common = x.among(y)
            total = np.concatenate([[0], np.cumsum(common)])
            may = x.whole & (100 * (total[width:] - total[:-width]) >= self.percent * x.size)
            if x.repeats and may.any():
                may &= 100 * distinct_counts(x.tokens, width, common) >= self.percent * x.size
            if not may.any():
                return False
            marks.append(may)
        self.may_x, self.may_y = marks
        self.near_x, self.near_y = (_spread(may, width) for may in marks)
        return True

    def cover(self, of_x: np.ndarray, of_y: np.ndarray) -> None:
        for inside, found in ((self.in_x, of_x), (self.in_y, of_y)):
            for s, e in found:
                inside[s:e] = True

    def diagonal(self, shift: int, low: int, high: int) -> None:
        x, y, width = self.x, self.y, self.width
        low, high = max(0, shift, low), min(len(x.tokens), len(y.tokens) + shift, high)
        if high - low < width:
            return
        a, b = slice(low, high - width + 1), slice(low - shift, high - shift - width + 1)
        equal = x.tokens[low:high] == y.tokens[low - shift:high - shift]
        total = np.concatenate([[0], np.cumsum(equal)])
        asked = self.percent * (x.size[a] + y.size[b])
        ok = ((100 + self.percent) * (total[width:] - total[:-width]) >= asked) & x.whole[a] & y.whole[b]
        if (ok & ((x.size[a] < width) | (y.size[b] < width))).any():
            # Repeated tokens count once.
            own = np.where(equal, x.tokens[low:high], mix(np.arange(high - low, dtype=np.uint64)))
            ok &= (100 + self.percent) * distinct_counts(own, width, equal) >= asked
        found = _stretches(low + np.flatnonzero(ok), width)
        self.cover(found, found - shift)

    def around(self, p: int, last: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """What like windows cover that hold a place of p to ``last`` and one so far from it in y, seen from p and its place in y."""
        x, y, width = self.x, self.y, self.width
        q, last_y = p - shift, last - shift
        fx, lx = max(0, p - width + 1), min(last, len(x.tokens) - width)
        fy, ly = max(0, q - width + 1), min(last_y, len(y.tokens) - width)
        xs, ys, may_x, may_y = x.tokens[fx:lx + width], y.tokens[fy:ly + width], self.may_x[fx:lx + 1], self.may_y[fy:ly + 1]
        none = np.zeros((0, 2), np.int64)
        if not (may_x.any() and may_y.any()):
            return none, none
        key = p - fx, q - fy, xs.tobytes(), ys.tobytes(), may_x.tobytes(), may_y.tobytes()
        if key not in self.tried:
            ok = Windows(xs, ys, width, self.percent, (x.size[fx:lx + 1], y.size[fy:ly + 1])).pairs(0, lx - fx, 0, ly - fy)
            if ok is not None:
                ok &= may_x[:, None] & may_y[None, :]
            self.tried[key] = (none, none) if ok is None else (
                _stretches(fx - p + np.flatnonzero(ok.any(axis=1)), width), _stretches(fy - q + np.flatnonzero(ok.any(axis=0)), width))
        return self.tried[key]

    def compare(self, places_x: np.ndarray, counts_x: np.ndarray, places_y: np.ndarray, counts_y: np.ndarray) -> None:
        """The places in x and y of each token in common, one token after the other, and how many."""
        width, many = self.width, []
        single = (counts_x == 1) & (counts_y == 1)
        begin_x, begin_y = np.cumsum(counts_x) - counts_x, np.cumsum(counts_y) - counts_y
        a, b = places_x[begin_x[single]], places_y[begin_y[single]]
        near = self.near_x[a] & self.near_y[b]
        p, q = [a[near]], [b[near]]
        for k in np.flatnonzero(~single):
            a, b = places_x[begin_x[k]:begin_x[k] + counts_x[k]], places_y[begin_y[k]:begin_y[k] + counts_y[k]]
            a, b = a[self.near_x[a]], b[self.near_y[b]]
            if len(a) * len(b) > 4 * width:
                many.append((a, b))
            else:
                p.append(np.repeat(a, len(b)))
                q.append(np.tile(b, len(a)))
        p, q = np.concatenate(p), np.concatenate(q)
        if len(p):
            hits = np.unique(np.stack([p - q, p], axis=1), axis=0)
            # A window more on both sides: like windows that hold no key of their own border on those that do.
            for low, high, shift in self._groups(hits, 4 * width, None):
                self.diagonal(shift, low - 2 * width, high + 2 * width)
            left = hits[~(self.in_x[hits[:, 1]] & self.in_y[hits[:, 1] - hits[:, 0]])]
            for low, high, shift in self._groups(left, width, width):
                if self.in_x[low] and self.in_y[low - shift] and (
                        low == high or self.in_x[low:high + 1].all() and self.in_y[low - shift:high - shift + 1].all()):
                    continue
                of_x, of_y = self.around(low, high, shift)
                self.cover(of_x + low, of_y + low - shift)
        # Tokens of repetitive stretches: places with the same surroundings are compared once.
        for a, b in many:
            if self._inside(a, b):
                continue
            of_a, of_b = self._alike_around(self.x, a), self._alike_around(self.y, b)
            # Where one group is larger than the others on both sides, the two often cover all.
            if all(len(of) == 1 or len(of[0]) > len(of[1]) for of in (of_a, of_b)):
                self._meet(of_a[0], of_b[0])
                if self._inside(a, b):
                    continue
            of_a, of_b = self._in_order(self.x, of_a), self._in_order(self.y, of_b)
            done_b = [bool(self.in_y[j].all()) for j in of_b]
            for i in of_a:
                done = bool(self.in_x[i].all())
                for k, j in enumerate(of_b):
                    if not (done and done_b[k]) and self._meet(i, j):
                        done, done_b = bool(self.in_x[i].all()), [bool(self.in_y[j].all()) for j in of_b]

    def _inside(self, a: np.ndarray, b: np.ndarray) -> bool:
        return bool(self.in_x[a].all() and self.in_y[b].all())

    def _meet(self, i: np.ndarray, j: np.ndarray) -> bool:
        """Cover what like windows around the places of x and y cover, each side's with the same surroundings; any?"""
        of_x, of_y = self.around(int(i[0]), int(i[0]), int(i[0] - j[0]))
        for inside, found, at in ((self.in_x, of_x, i), (self.in_y, of_y, j)):
            for s, e in found:
                if len(at) == 1:
                    inside[at[0] + s:at[0] + e] = True
                else:
                    inside |= _covered(at + s, at + e, len(inside))
        return len(of_x) > 0

    @staticmethod
    def _groups(hits: np.ndarray, gap: int, most: int | None) -> Iterator[tuple[int, int, int]]:
        """(first, last, shift) of hits (shift, place) at one shift that are near each other, and no further apart than ``most``."""
        if not len(hits):
            return
        shift, p = hits[:, 0], hits[:, 1]
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(shift) != 0) | (np.diff(p) > gap)) + 1, [len(p)]])
        for b, e in zip(cuts[:-1], cuts[1:]):
            while most is not None and p[e - 1] - p[b] > most:
                k = b + int(np.searchsorted(p[b:e], p[b] + most, "right"))
                yield int(p[b]), int(p[k - 1]), int(shift[b])
                b = k
            yield int(p[b]), int(p[e - 1]), int(shift[b])

    @staticmethod
    def _alike_around(text: Packed, places: np.ndarray) -> list[np.ndarray]:
        """The places by what stands within a window of them, those in the middle of a text first."""
        _, of, counts = np.unique(text.surroundings(places), return_inverse=True, return_counts=True)
        places, ends = places[np.argsort(of, kind="stable")], np.cumsum(counts).tolist()
        return sorted((places[b:e] for b, e in zip([0, *ends], ends)), key=len, reverse=True)

    @staticmethod
    def _in_order(text: Packed, groups: list[np.ndarray]) -> list[np.ndarray]:
        """Groups of one size by a hash of their surroundings, token by token."""
        if len(groups) == 1:
            return groups
        width, total = text.width, np.zeros(len(groups), np.uint64)
        around = np.concatenate([np.zeros(width, np.uint64), text.tokens, np.zeros(width, np.uint64)])
        three, some = np.uint64(3), np.empty_like(total)
        for row in around[np.array([g[0] for g in groups]) + np.arange(1, 2 * width)[:, None]]:
            total *= three
            total += row
            mix_in_place(total, some)
        return [groups[k] for k in np.lexsort((total, [-len(g) for g in groups]))]

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) in the whole texts."""
        out = []
        for text, inside in ((self.x, self.in_x), (self.y, self.in_y)):
            # Stretches that stand side by side in a packed text only are cut.
            edges = np.zeros(len(inside) + 1, bool)
            edges[text.offset] = True
            begin = np.flatnonzero(inside & (edges[:-1] | ~np.concatenate([[False], inside[:-1]])))
            end = np.flatnonzero(inside & (edges[1:] | ~np.concatenate([inside[1:], [False]])))
            out.append(np.stack([text.outside(begin), text.outside(end) + 1], axis=1))
        return out[0], out[1]


_PAIR = ("a", "b", "p", "n_p", "q", "n_q", "x", "x_begin", "x_offset", "y", "y_begin", "y_offset")


def _verify(width: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, y, of_y = [], None, None
            for a, b, p, n_p, q, n_q, *text in zip(*(batch[c] for c in _PAIR)):
                if b != of_y:
                    y, of_y = Packed(*text[3:], width), b
                pairs = Comparison(Packed(*text[:3], width), y, width, percent)
                if not pairs.may():
                    continue
                pairs.compare(pairs.x.inside(p), n_p, y.inside(q), n_q)
                for found, own, other in zip(pairs.spans(), (a, b), (b, a)):
                    rows += [(own, s, e, other) for s, e in found.tolist()]
            yield pd.DataFrame(rows, columns=["class_id", "start", "end", "partner"])

    return run


def _cut(width: int):
    """The first text of a pair as far as two windows around the hits reach, so that little is sent to the second."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for p, tokens, begin, offset in zip(*(batch[c] for c in ("p", "x", "x_begin", "x_offset"))):
                tokens = np.frombuffer(tokens, np.uint64)
                begin, offset = (np.frombuffer(b, np.int32).astype(np.int64) for b in (begin, offset))
                p = np.sort(p)
                p = p - (begin - offset)[np.searchsorted(begin, p, "right") - 1]
                if p[0] <= 2 * width and p[-1] + 2 * width >= len(tokens) and (np.diff(p) <= 4 * width).all():
                    texts.append((tokens.tobytes(), begin, offset))
                    continue
                keep = _covered(p - 2 * width, p + 2 * width, len(tokens))
                # A stretch goes on where neither a token is left out nor another stretch begins.
                first = keep & ~np.concatenate([[False], keep[:-1]])
                first[offset] = keep[offset]
                places = np.flatnonzero(first)
                of = np.searchsorted(offset, places, "right") - 1
                texts.append((tokens[keep].tobytes(), places - offset[of] + begin[of], (np.cumsum(keep) - 1)[places]))
            yield batch.assign(x=[t for t, *_ in texts], x_begin=[b.astype(np.int32).tobytes() for _, b, _ in texts],
                               x_offset=[o.astype(np.int32).tobytes() for *_, o in texts])

    return run


def _hits(asking: DataFrame, others: DataFrame, unless: str) -> DataFrame:
    """``a, b, p, q``: the places in two texts, a before b, of the tokens that rows of both hold."""
    met = asking.alias("a").join(others.alias("b"), F.expr(f"a.token = b.token AND a.class_id <> b.class_id AND NOT ({unless})"))
    return met.select(*_in_pairs(F.col("a.class_id"), F.col("a.places"), F.col("b.class_id"), F.col("b.places")), F.lit(True).alias("met"))


def _in_pairs(x: Column, p: Column, y: Column, q: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(x < y, p).otherwise(q).alias("p"), F.when(x < y, q).otherwise(p).alias("q")]


def _pairs(hits: DataFrame) -> DataFrame:
    """All hits of the pairs that have one with ``met``."""
    return scratch(hits.groupBy("a", "b").agg(F.collect_list(F.struct("p", "q")).alias("hits"), F.bool_or("met").alias("met")).filter("met").select(
        "a", "b", *[F.expr(e).alias(k) for k in ("p", "q") for k, e in (
            (k, f"flatten(hits.{k})"), (f"n_{k}", f"transform(hits.{k}, x -> size(x))"))]), "pairs")


def _compared(pairs: DataFrame, arrays: DataFrame, width: int, percent: int) -> DataFrame:
    """``class_id, start, end, partner`` of the like stretches around the hits of the pairs."""
    wanted = scratch(pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct(), "wanted")
    arrays = semi_join_ids(arrays, wanted, "class_id")
    x, y = (arrays.select(F.col("class_id").alias(k), F.col("tokens").alias(n), F.col("begin").alias(f"{n}_begin"),
                          F.col("offset").alias(f"{n}_offset")) for k, n in (("a", "x"), ("b", "y")))
    near = pairs.join(x, "a")
    spans = scratch(near.mapInPandas(_cut(width), near.schema).join(y, "b").mapInPandas(
        _verify(width, percent), "class_id long, start int, end int, partner long"), "spans")
    discard(pairs, wanted)
    return spans


def _open(asking: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows with the places that are in no span yet."""
    found = spans.select("class_id", "start", "end").distinct().groupBy("class_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    left = F.expr("filter(places, p -> NOT exists(spans, s -> s.start <= p AND p < s.end))")
    return asking.join(found, "class_id", "left").withColumn(
        "places", F.when(F.col("spans").isNull(), F.col("places")).otherwise(left)).filter("size(places) > 0").drop("spans")


def _near(tokens: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Which windows hold one of the places."""
    return _covered(places - width + 1, places + 1, len(tokens) - width + 1)


def _contexts(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, classes, size = [], [], 0
            for c, held, *text in zip(*(batch[k] for k in ("class_id", "held", "tokens", "begin", "offset"))):
                x = Packed(*text, width)
                held = x.inside(held)
                parts.append(np.unique(x.tokens[_covered(held - width + 1, held + width, len(x.tokens))]))
                classes.append(c)
                size += len(parts[-1])
                if size > 200_000:
                    yield _table(parts, classes)
                    parts, classes, size = [], [], 0
            if parts:
                yield _table(parts, classes)

    def _table(parts, classes):
        return pd.DataFrame({"token": signed(np.concatenate(parts)), "class_id": np.repeat(np.array(classes, np.int64), [len(p) for p in parts])})

    return run


def _shared_tokens(r, x: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The known tokens, sorted, their counts, where each token of x is among them, and whether it is."""
    known = np.asarray(r.known, np.int64).view(np.uint64)
    order = np.argsort(known)
    known, counts = known[order], np.asarray(r.counts, np.int64)[order]
    at = np.minimum(np.searchsorted(known, x.tokens), len(known) - 1)
    return known, counts, at, known[at] == x.tokens


def _window_sets(width: int, buckets: int):
    """Rows of the sets of tokens of the windows around the places held of which other texts have every token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                x = Packed(r.tokens, r.begin, r.offset, width)
                whole = np.concatenate([[0], np.cumsum(_shared_tokens(r, x)[3])])
                held = _near(x.tokens, x.inside(np.unique(np.asarray(r.held, np.int64))), width)
                starts = np.flatnonzero(held & x.whole & (whole[width:] - whole[:-width] == width))
                if len(starts):
                    named = np.array([r.unnamed == 0])
                    parts.append((set_hashes(x.tokens, width)[starts], *(np.repeat(v, len(starts)) for v in (
                        np.int64(r.class_id), np.int64(r.least_id), named)), x.outside(starts).astype(np.int32), np.zeros(len(starts), np.uint64)))
                    size += len(starts)
            if size > 400_000:
                yield _blocks(parts, buckets).to_pandas()
                parts, size = [], 0
        if parts:
            yield _blocks(parts, buckets).to_pandas()

    return run


_SETTLED = "class_id long, starts array<int>, unnamed boolean, least_id long, partner long"


def _settled(block: pa.Table) -> pa.Table:
    """The windows whose set of tokens a window of another text has, and the other of the least id, by text."""
    x = Shared(block)
    head, second = x.rank[x.first], x.rank[x.first + 1] if len(x.first) else x.rank
    partner = np.where(head[x.set] == np.arange(len(x.at)), second[x.set], head[x.set])
    order = np.lexsort((x.class_id[partner], x.id[partner], ~x.named[partner], x.class_id))
    first = np.flatnonzero(Shared._breaks(x.class_id[order]))
    sizes = x.ends[order] - x.at[order]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    starts = x.places[np.repeat(x.at[order] - offsets[:-1], sizes) + np.arange(offsets[-1])]
    best = partner[order[first]]
    return pa.table([pa.array(x.class_id[order[first]]), pa.ListArray.from_arrays(
        pa.array(np.append(offsets[first], offsets[-1]).astype(np.int32)), pa.array(starts.astype(np.int32))),
        pa.array(~x.named[best]), pa.array(x.id[best]), pa.array(x.class_id[best])], names=["class_id", "starts", "unnamed", "least_id", "partner"])


def _settled_spans(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, s, e, partner) for c, starts, partner in zip(batch["class_id"], batch["settled"], batch["partner"])
                    for s, e in _stretches(np.unique(np.asarray(starts, np.int64)), width).tolist()]
            yield pd.DataFrame(rows, columns=["class_id", "start", "end", "partner"])

    return run


def _rarest(number: np.ndarray, starts: np.ndarray, none: int, size: np.ndarray, enough: np.ndarray, flags_of: np.ndarray,
            width: int, percent: int) -> np.ndarray:
    """Rarest tokens of the windows: number, then a bit each for settled, asked, weak and full, then 32 bits of the place."""
    alike = -(-2 * percent * width // (100 + percent))
    rows = np.lib.stride_tricks.sliding_window_view(number, width)[starts] * width + np.arange(width)
    size, dead = size[starts], size[starts] - enough[starts]
    most = size - -(-percent * size // 100) + 1 - dead
    rows.sort(axis=1)
    token = rows // width
    new = token < none
    new[:, 1:] &= token[:, 1:] != token[:, :-1]
    nth = np.cumsum(new, axis=1) - 1
    i, j = np.nonzero(new & (nth < most[:, None]))
    full = size[i] == width
    weak = full & (nth[i, j] >= width - alike + 1 - dead[i])
    flags = flags_of[starts[i]] + 2 * weak + full
    return ((token[i, j] << 4 | flags) << 32) + starts[i] + rows[i, j] % width


def _prefixes(width: int, percent: int):
    """Rows of the rarest tokens of each window, so many that like windows share one of them.

    Tokens that no other text has around these places count as not shared. ``weak``: the row only
    matters for windows that repeat a token; ``full``: it comes from a window that doesn't;
    ``settled``: from one whose set of tokens another text has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for r in batch.itertuples(index=False):
                x = Packed(r.tokens, r.begin, r.offset, width)
                known, counts, at, shared = _shared_tokens(r, x)
                held, asked = (_near(x.tokens, x.inside(np.unique(np.asarray(p if p is not None else [], np.int64))), width)
                               for p in (r.held, r.asked))
                enough = distinct_counts(x.tokens, width, shared)
                # Tokens by number, the rarest first.
                rarest = np.lexsort((known, counts))
                number = np.empty(len(known), np.int64)
                number[rarest] = np.arange(len(known))
                number = np.where(shared, number[at], len(known))
                flags = 4 * asked
                if (settled := getattr(r, "settled", None)) is not None:
                    flags[x.inside(np.asarray(settled, np.int64))] += 8
                starts = np.flatnonzero(held & x.whole & (100 * enough >= percent * x.size))
                some = [_rarest(number, starts[k:k + 20_000], len(known), x.size, enough, flags, width, percent)
                        for k in range(0, len(starts), 20_000)]
                if not some:
                    continue
                found = np.unique(np.concatenate(some))
                places, found = found & 0xFFFFFFFF, found >> 32
                first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                found = found[first]
                parts.append((known[rarest[found >> 4]], found, np.full(len(found), r.class_id, np.int64),
                              np.diff(first, append=len(places)), x.outside(places)))
            if parts:
                tokens, found, classes, sizes, places = (np.concatenate(p) for p in zip(*parts))
                places, ends = places.astype(np.int32), np.cumsum(sizes).tolist()
                yield pd.DataFrame({"token": signed(tokens), "class_id": classes, "asks": found & 4 > 0, "weak": found & 2 > 0, "full": found & 1 > 0,
                                    "settled": found & 8 > 0, "places": [places[b:e] for b, e in zip([0, *ends], ends)]})

    return run


def _rest(asking: DataFrame, members: DataFrame, arrays: DataFrame, least: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """Like stretches of rows of large buckets with any text of the bucket, by the tokens around them.

    Windows with the same set of tokens are alike and found by its hash; two that both have such a
    one in another text need not be compared.
    """
    places = F.flatten(F.collect_list("places"))
    tokens = scratch(asking.select("token").distinct(), "buckets")
    held = semi_join_ids(members, tokens, "token").groupBy("class_id").agg(places.alias("held"))
    held = scratch(held.join(asking.groupBy("class_id").agg(places.alias("asked")), "class_id", "left"), "held")
    tokens = scratch(held.join(arrays, "class_id").mapInPandas(_contexts(width), "token long, class_id long"), "contexts")
    counts = scratch(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    known = semi_join_ids(tokens, counts.select("token"), "token").join(counts, "token").groupBy("class_id").agg(
        F.collect_list(F.struct("token", "n")).alias("k"))
    known = scratch(held.join(known.select("class_id", F.col("k.token").alias("known"), F.col("k.n").alias("counts")), "class_id"), "known")
    discard(tokens, counts)
    around = known.join(arrays, "class_id")
    sets = around.drop("asked", "counts").withColumn("counts", F.col("known")).join(least.select(
        "class_id", F.col("partner_id").isNull().alias("unnamed"), F.coalesce("partner_id", F.lit(0).cast("long")).alias("least_id")), "class_id")
    settled = sets.mapInPandas(_window_sets(width, buckets), _BLOCK).groupBy("bucket").applyInArrow(_settled, _SETTLED)
    settled = scratch(settled.groupBy("class_id").agg(F.flatten(F.collect_list("starts")).alias("settled"), F.min(
        F.struct("unnamed", "least_id", "partner")).getField("partner").alias("partner")), "settled")
    rows = scratch(around.join(settled.drop("partner"), "class_id", "left").mapInPandas(
        _prefixes(width, percent), "token long, class_id long, asks boolean, weak boolean, full boolean, settled boolean, places array<int>"), "prefixes")
    unless, asking = "a.weak AND b.full OR b.weak AND a.full", rows.filter("asks")
    hits = _hits(asking.filter("NOT settled"), rows, unless).unionByName(_hits(asking.filter("settled"), rows.filter("NOT settled"), unless))
    spans = settled.mapInPandas(_settled_spans(width), "class_id long, start int, end int, partner long")
    return _compared(_pairs(hits), arrays, width, percent).unionByName(spans)


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                      percent: int = PERCENT) -> DataFrame:
    """``doc_id, spans, repeated_words, n_words, partner_id`` of documents with a repeated passage.

    ``spans`` lists (start, end) in words, the end exclusive, in order and without overlap: where
    ``min_words`` words or more are also in another document, alike by ``percent`` of their
    shingles. ``partner_id`` is the least id of a document that one of them was found in. Copies of
    a whole text of that length are spans as a whole. Every document with such a
    passage is proposed (see ``run_lengths``) and verified. A span may leave out words at its ends
    that only another document than the compared ones has.

    NULL, empty and short texts have no passage and give no row; rows without an id are not
    reported, but count as copies (``partner_id`` is NULL when a passage is in such rows only). Rows that repeat an id are one document: its own passages
    don't repeat across documents. Further columns are ignored.
    """
    width = min_words - SHINGLE + 1
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = scratch(base.withColumn("text_hash", F.xxhash64("text")).mapInPandas(
        _documents, "doc_id long, text_hash long, class_id long, n_words long, slice int, counts binary"), "classes")
    docs, counted = docs.filter("counts IS NULL").drop("slice", "counts"), docs.filter("counts IS NOT NULL")
    # The text that stands for a class is one of the least id.
    classes = scratch(docs.filter(F.col("n_words") >= min_words).groupBy("class_id").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("n_words").alias("n_words"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).getField("text_hash").alias("text_hash")), "classes")
    texts = texts_of(base, classes.select(F.col("least").alias("doc_id"), "text_hash"))
    buckets = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = scratch(texts.select("doc_id", "text").mapInArrow(
        _keys(width, percent, _frequent(counted, docs.count()), buckets), _BLOCK).groupBy("bucket").applyInArrow(_members, _MEMBERS), "members")
    least = classes.select("class_id", F.col("least").alias("partner_id"))
    # In each bucket the text of the least id is compared with each other.
    others = members.filter("class_id <> head")
    pairs = _pairs(others.select(*_in_pairs(*map(F.col, ("class_id", "places", "head", "head_places"))), "met"))
    members = members.drop("head_places", "met")
    some = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).union(members.filter("size > 2 AND NOT alone").select("class_id")).distinct()
    near = scratch(members.groupBy("class_id").agg(F.flatten(F.collect_list("places")).alias("places")).join(some, "class_id", "left_semi").join(
        classes.select("class_id", "text_hash"), "class_id").drop("class_id"), "near")
    texts = semi_join_ids(texts.withColumn("text_hash", F.xxhash64("text")), scratch(near.select("text_hash"), "near"), "text_hash")
    arrays = scratch(texts.join(near, "text_hash").mapInPandas(
        _packed(width), "class_id long, tokens binary, begin binary, offset binary"), "packed")
    spans = _compared(pairs, arrays, width, percent)
    members = members.filter("size > 2 AND NOT alone").select("token", "class_id", "places", "head")
    asking = scratch(_open(members.filter("class_id <> head").drop("head"), spans), "asking")
    if not asking.isEmpty():
        spans = spans.unionByName(_rest(asking, members, arrays, least, width, percent, buckets))
    stretches = spans.join(least.withColumnRenamed("class_id", "partner"), "partner").groupBy("class_id", "start").agg(
        F.max("end").alias("end"), F.min("partner_id").alias("partner_id"))
    merged = stretches.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found"),
                                               F.min("partner_id").alias("partner_id"))
    merged = merged.select("class_id", "partner_id", F.expr(f"""aggregate(found, cast(array() as array<struct<start:int,end:int>>),
        (acc, s) -> if(size(acc) > 0 AND element_at(acc, -1).end + {SHINGLE - 1} >= s.start,
            concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start,
                'end', greatest(element_at(acc, -1).end, s.end + {SHINGLE - 1})))),
            concat(acc, array(named_struct('start', s.start, 'end', s.end + {SHINGLE - 1})))))""").alias("spans"))
    copies = classes.filter("least < most").select("class_id", F.col("least").alias("copy_of"), "n_words")
    found = docs.drop("text_hash").filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words)).distinct().join(
        merged, "class_id", "left").join(copies.drop("n_words"), "class_id", "left").filter(
        "spans IS NOT NULL OR copy_of IS NOT NULL")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    spans_of = F.when(F.col("copy_of").isNotNull(), whole).otherwise(F.col("spans"))
    return found.select("doc_id", spans_of.alias("spans"), "n_words", F.least("copy_of", "partner_id").alias("partner_id")
                        ).withColumn("repeated_words", F.expr(
                            "aggregate(spans, 0L, (n, s) -> n + cast(s.end - s.start as bigint))"))

