"""Operator 4: secret scans by rules and a character convolutional network.

Three rules give the base findings, which always stay. Every other token that could be a
credential is a candidate; a small convolutional network reads its characters and the text around
it. The network is trained on labelled findings: what the rules found (and the same contexts with
random keys of other alphabets put in place of the value) against tokens that are no credentials.
All distinct findings take part: they are dealt to tasks, each task goes through its own once a
round, and the mean of the tasks' weights is where the next round begins. Scores are calibrated on
all findings kept back from the fit, and the threshold is the highest that keeps the recall asked
for on them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import scratch

# The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "network")

#: Tokens the network looks at: 12 characters or more, with a digit and a letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")

LEFT, VALUE, RIGHT = 24, 64, 12   # characters of context and value in one window
SHARD = 4_000                     # labelled findings that one task goes through; more of them make more tasks
EPOCHS = 8
CELLS = 1_000                     # cells a unit of the logit is counted in when scores are calibrated
RECALL = 0.99

_CLASSES = np.full(128, 6, np.int64)
_CLASSES[[ord(c) for c in "abcdef"]] = 1
_CLASSES[[ord(c) for c in "ghijklmnopqrstuvwxyz"]] = 2
_CLASSES[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 3
_CLASSES[[ord(c) for c in "0123456789"]] = 4
_CLASSES[[ord(c) for c in " \t\n\r"]] = 5
for _place, _char in enumerate("=:\"'+/_-.@()#<>,"):
    _CLASSES[ord(_char)] = 7 + _place
CHANNELS = 7 + 16 + 2 + 26        # classes, other, inside the value, and the letters by themselves


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Findings of the rules: leftmost and non-overlapping within each kind."""
    found = []
    folded = text.lower()
    if any(k in folded for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def value_start(text: str, kind: str, start: int) -> int:
    """Where the value of a base finding begins, behind the name it is assigned to."""
    return ASSIGN.match(text, start).start(2) if kind == "assign" else start


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens that might be credentials and overlap no base finding."""
    out, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while k < len(taken) and taken[k][1] < e:  # base findings stand by start: all that begin before e
            reach = max(reach, taken[k][2])
            k += 1
        if reach <= s and _DIGIT.search(m.group()) and _LETTER.search(m.group()):
            out.append((s, e))
    return out


def windows(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """Pieces of a value with their context; a value longer than a window gives several."""
    return [(text[max(0, s - LEFT):min(e, end) + RIGHT], s - max(0, s - LEFT), min(e, end) - max(0, s - LEFT))
            for s in range(start, max(start + 1, end - VALUE // 2 if end - start > VALUE else start + 1), VALUE // 2)
            for e in [s + VALUE]]


def encode(pieces: list[tuple[str, int, int]]) -> np.ndarray:
    """One-hot characters, aligned so that the value begins at the same place in each window; a byte each."""
    width = LEFT + VALUE + RIGHT
    out = np.zeros((len(pieces), width, CHANNELS), np.uint8)
    for row, (text, begin, end) in enumerate(pieces):
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        at = np.arange(len(codes)) + LEFT - begin
        kind = np.where(codes < 128, _CLASSES[np.minimum(codes, 127)], 0)
        out[row, at, kind] = 1
        out[row, at[begin:end], 23] = 1
        folded = codes | 32
        plain = (folded >= 97) & (folded <= 122) & (codes < 128)
        out[row, at[plain], 25 + (folded[plain] - 97).astype(np.int64)] = 1
    return out


class CharNetwork:
    """Embedding, one convolution over characters, maximum over places, logistic output."""

    def __init__(self, filters: int = 24, width: int = 5, depth: int = 10, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.width = width
        self.p = {"embed": rng.normal(0, 0.3, (CHANNELS, depth)), "conv": rng.normal(0, 0.2, (width * depth, filters)),
                  "shift": np.zeros(filters), "out": rng.normal(0, 0.2, 2 * filters), "bias": np.zeros(1)}
        self.first = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.step = 0
        self.slope, self.offset, self.threshold = 1.0, 0.0, 0.5
        self.fitted_on = (0, 0)  # findings of label 0 and of label 1, the ones kept back among them

    @property
    def state(self) -> np.ndarray:
        """Weights, their moments and the steps so far as one row."""
        return np.concatenate([*(v.ravel() for part in (self.p, self.first, self.second) for v in part.values()), [self.step]])

    @state.setter
    def state(self, row: np.ndarray) -> None:
        at = 0
        for part in (self.p, self.first, self.second):
            for k, v in part.items():
                part[k], at = row[at:at + v.size].reshape(v.shape).copy(), at + v.size
        self.step = float(row[at])

    def _forward(self, x):
        """Of some windows at a time: their bytes become floating point here."""
        x = x.astype(np.float32)
        e = x @ self.p["embed"]
        span = e.shape[1] - self.width + 1
        cols = np.concatenate([e[:, k:k + span] for k in range(self.width)], axis=2)
        z = np.maximum(cols @ self.p["conv"] + self.p["shift"], 0)
        inside = x[:, :span, 23:24]
        share = inside / np.maximum(inside.sum(axis=1, keepdims=True), 1)
        top = z.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(z, top[:, None, :], 1)[:, 0], (z * share).sum(axis=1)], axis=1)
        return e, cols, z, share, top, pooled, pooled @ self.p["out"] + self.p["bias"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[b:b + 256])[-1] for b in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 4, done: int = 0) -> None:
        """Go on for ``epochs`` after the ``done`` ones."""
        rng = np.random.default_rng(seed)
        first, second, n = self.first, self.second, self.p["conv"].shape[1]
        for epoch in range(done + epochs):
            order = rng.permutation(len(x))
            if epoch < done:
                continue
            for b in range(0, len(x), 64):
                rows = order[b:b + 64]
                xb = x[rows]
                e, cols, z, share, top, pooled, logit = self._forward(xb)
                d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows)
                g = {"out": pooled.T @ d, "bias": np.array([d.sum()])}
                dp = d[:, None] * self.p["out"]
                dz = dp[:, None, n:] * share
                best = np.zeros_like(z)
                np.put_along_axis(best, top[:, None, :], dp[:, None, :n], 1)
                dz = (dz + best) * (z > 0)
                flat = dz.reshape(-1, n)
                g["conv"], g["shift"] = cols.reshape(-1, cols.shape[2]).T @ flat, flat.sum(axis=0)
                dcols = dz @ self.p["conv"].T
                de, depth, span = np.zeros_like(e), e.shape[2], dz.shape[1]
                for k in range(self.width):
                    de[:, k:k + span] += dcols[:, :, k * depth:(k + 1) * depth]
                g["embed"] = xb.reshape(-1, CHANNELS).astype(np.float32).T @ de.reshape(-1, depth)
                self.step += 1
                for k, v in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.p[k] -= rate * (first[k] / (1 - 0.9 ** self.step)) / (np.sqrt(second[k] / (1 - 0.999 ** self.step)) + 1e-8)

    def scale(self, logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Platt scaling of logits that stand for ``weight`` findings each."""
        ones, zeros = float(weight[y > 0].sum()), float(weight[y == 0].sum())
        target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
        a, b = 1.0, 0.0
        for _ in range(500):
            d = (1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30))) - target) * weight
            a, b = a - 0.05 * (d * logit).sum() / (ones + zeros), b - 0.05 * d.sum() / (ones + zeros)
        self.slope, self.offset = max(a, 1e-3), b

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling, then the highest threshold with the recall asked for."""
        logit = self.logits(x)
        self.scale(logit, y, np.ones(len(y)))
        scores = np.sort(self.calibrated(logit)[y > 0])
        self.threshold = float(scores[int((1 - recall) * len(scores))]) if len(scores) else 1.1

    def calibrated(self, logit):
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.offset, -30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(x))


def labelled_examples(found: list[tuple[str, int, int, int]], seed: int = 4):
    """Windows and labels. Random keys also stand in place of the values that the rules found, and
    in place of tokens that are none, so that characters as well as context decide."""
    rng = np.random.default_rng(seed)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
                 "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
                 "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef"]
    plain = [w for w in found if w[3] == 0]
    pieces, labels = [], []
    for text, begin, end, label in found:
        pieces.append((text, begin, end))
        labels.append(label)
        if label:
            for around in (None, plain[int(rng.integers(len(plain)))] if plain else None):
                left, right = (text[:begin], text[end:]) if around is None else (around[0][:around[1]], around[0][around[2]:])
                key = "".join(rng.choice(list(alphabets[int(rng.integers(len(alphabets)))]), int(rng.integers(20, 48))))
                pieces.append((left + key + right, len(left), len(left) + len(key)))
                labels.append(1)
        elif len(text) - end > 2:
            # Words and numbers run together look like tokens but are none.
            words = re.findall(r"[A-Za-z]{3,}", text)
            if words:
                fake = "-".join(rng.choice(words, 4)) + str(int(rng.integers(1, 2030)))
                left = text[:begin]
                pieces.append((left + fake + text[end:], len(left), len(left) + len(fake)))
                labels.append(0)
    return pieces, np.array(labels, np.float64)


def examples_of(found: list[tuple[str, int, int, int]], kept_back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Encoded windows and labels of the findings that are learned, or of those kept back.

    They are split by finding, so that no context is both learned and measured."""
    found = sorted(found)
    held = np.random.default_rng(5).random(len(found)) < 0.25
    pieces, y = labelled_examples([f for f, k in zip(found, held) if k == kept_back])
    return encode([windows(t, b, e)[0] for t, b, e in pieces]), y


def fit(found: list[tuple[str, int, int, int]], recall: float = RECALL) -> CharNetwork | None:
    """Network trained on windows (text, begin, end, label); None without both labels."""
    learned, held = examples_of(found, False), examples_of(found, True)
    if len(set(learned[1])) < 2 or len(set(held[1])) < 2:
        return None
    network = CharNetwork()
    network.train(*learned)
    network.calibrate(*held, recall)
    network.fitted_on = tuple(sum(f[3] == label for f in found) for label in (0, 1))
    return network


def _labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            if not isinstance(text, str):
                continue
            base = base_spans(text)
            spots = []
            for kind, s, e in base:
                spots.append((value_start(text, kind, s), e, 1))
            spots += [(s, e, 0) for s, e in candidates(text, base)]
            for s, e, label in spots:
                a, e = max(0, s - LEFT), min(e, s + VALUE)
                rows.append((label, text[a:e + RIGHT], s - a, e - a))
        yield pd.DataFrame(rows, columns=["label", "piece", "begin", "end"])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL,
                 shard: int = SHARD) -> DataFrame:
    """``doc_id, findings`` for every row of ``df``: an array of (kind, start, end, score).

    Positions are code points, the end exclusive; findings stand by start, then kind in the order
    of ``KINDS``. Base findings stay whatever the network scores them (1 without a network). The network is fitted on all distinct
    labelled findings, about ``shard`` of them in a task; it adds tokens whose calibrated score
    reaches the threshold. Without findings of both labels it adds none.
    NULL and empty texts have no finding; repeated rows each get a row; further columns are ignored.
    """
    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    network = learn_network(base, "text", recall, shard)
    kind = dict(base.dtypes)["doc_id"]
    return base.mapInPandas(_scanner(network), f"doc_id {kind}, findings array<struct<kind:string,start:long,end:long,score:double>>")


def learn_network(df: DataFrame, text_col: str = "text", recall: float = RECALL, shard: int = SHARD) -> CharNetwork | None:
    """The network fitted and calibrated on all distinct labelled findings of ``df``, dealt to tasks by a hash.

    Without findings of both labels in the fit and in what is kept back there is none. The driver
    holds sums of weights (64 rows at most) and counts of logits by cell.
    """
    examples = df.select(F.col(text_col).cast("string").alias("text")).mapInPandas(
        _labelled, "label int, piece string, begin int, end int")
    distinct = examples.groupBy("label", "piece", "begin", "end").agg(
        F.first(F.xxhash64("piece", "begin")).alias("rank"))
    distinct = scratch(distinct, "findings")
    found = {r["label"]: r["count"] for r in distinct.groupBy("label").count().collect()}
    if len(found) < 2:
        return None
    shards = -(-sum(found.values()) // shard)
    # A number of partitions of its own: small as the findings are, each shard is work for a task.
    dealt = distinct.withColumn("shard", F.pmod("rank", F.lit(shards)).cast("int")).repartition(shards, "shard").groupBy("shard")
    network = CharNetwork()
    network.fitted_on = (found[0], found[1])
    rounds = 1 if shards == 1 else EPOCHS
    for done in range(0, EPOCHS, EPOCHS // rounds):
        fitted = dealt.applyInPandas(_trained(network, done, EPOCHS // rounds), _STATE)
        sums = fitted.groupBy(F.pmod("shard", F.lit(64)).alias("part")).applyInPandas(_sum_of_states, _STATE).orderBy("shard").collect()
        if not (any(r.ones for r in sums) and any(r.zeros for r in sums)):
            return None
        network.state = np.sum([r.state for r in sums], axis=0) / sum(r.shards for r in sums)
    logits = scratch(dealt.applyInPandas(_logits(network), "label int, logit double, cell long"), "logits")
    cells = logits.groupBy("label", "cell").count().orderBy("label", "cell").toPandas()
    label, cell, count = (cells[c].to_numpy() for c in ("label", "cell", "count"))
    if len(set(label)) < 2:
        return None
    network.scale((cell + 0.5) / CELLS, label, count)
    # The cell that holds the finding at the quantile, then the finding in it.
    cell, upto = cell[label > 0], np.cumsum(count[label > 0])
    place = int((1 - recall) * upto[-1])
    at = int(np.searchsorted(upto, place, "right"))
    inside = place - int(upto[at - 1] if at else 0)
    least = logits.filter((F.col("label") == 1) & (F.col("cell") == int(cell[at]))).orderBy("logit").limit(inside + 1)
    network.threshold = float(network.calibrated(least.agg(F.max("logit")).first()[0]))
    return network


_STATE = "shard int, shards long, zeros long, ones long, state array<double>"


def _found_in(rows: pd.DataFrame) -> list[tuple[str, int, int, int]]:
    return list(zip(rows["piece"], rows["begin"].tolist(), rows["end"].tolist(), rows["label"].tolist()))


def _trained(network: CharNetwork, done: int, epochs: int):
    begin = network.state

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        network.state = begin  # also where a worker takes several shards
        x, y = examples_of(_found_in(rows), False)
        network.train(x, y, epochs, done=done)
        return pd.DataFrame({"shard": rows["shard"].iloc[:1].to_numpy(), "shards": [1], "zeros": [int((y == 0).sum())],
                             "ones": [int((y > 0).sum())], "state": [network.state]})

    return run


def _sum_of_states(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("shard")  # always the same order of additions
    return pd.DataFrame({"shard": rows["shard"].iloc[:1].to_numpy(), "shards": [rows["shards"].sum()], "zeros": [rows["zeros"].sum()],
                         "ones": [rows["ones"].sum()], "state": [np.sum(np.stack(rows["state"]), axis=0)]})


def _logits(network: CharNetwork):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = examples_of(_found_in(rows), True)
        logit = network.logits(x)
        return pd.DataFrame({"label": y.astype(np.int32), "logit": logit, "cell": np.floor(logit * CELLS).astype(np.int64)})

    return run


def redact_secrets(df: DataFrame, text_col: str = "text", recall: float = RECALL,
                   shard: int = SHARD) -> DataFrame:
    """The rows and columns of ``df`` with each finding in the text replaced by ``[SECRET]``."""
    network = learn_network(df, text_col, recall, shard)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[text_col] = [mask(t, f) for t, f in zip(batch[text_col], findings_of(batch[text_col], network))]
            yield batch

    return df.mapInPandas(run, df.schema)


def _scanner(network: CharNetwork | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["doc_id"]].copy()
            out["findings"] = findings_of(batch["text"], network)
            yield out

    return run


def findings_of(texts, network: CharNetwork | None) -> list[list[dict]]:
    listed, asked = [], []
    for row, text in enumerate(texts):
        found = base_spans(text) if isinstance(text, str) else []
        listed.append([{"kind": k, "start": s, "end": e, "score": 1.0} for k, s, e in found])
        if network is not None and found:
            asked += [(row, n, s, e, w) for n, (k, s, e) in enumerate(found) for w in windows(text, value_start(text, k, s), e)]
        if network is not None and isinstance(text, str):
            asked += [(row, None, s, e, w) for s, e in candidates(text, found) for w in windows(text, s, e)]
    best: dict[tuple, float] = {}
    for b in range(0, len(asked), 256):
        part = asked[b:b + 256]
        for (*spot, _), score in zip(part, network.score(encode([w for *_, w in part]))):
            best[*spot,] = max(best.get((*spot,), 0.0), float(score))
    for (row, n, s, e), score in best.items():
        if n is not None:
            listed[row][n]["score"] = score
        elif score >= network.threshold:
            listed[row].append({"kind": "network", "start": s, "end": e, "score": score})
    for spans in listed:
        spans.sort(key=lambda f: (f["start"], KINDS.index(f["kind"]), f["end"]))
    return listed


def mask(text: str | None, findings) -> str | None:
    if not isinstance(text, str) or findings is None or not len(findings):
        return text
    out, at = [], 0
    for f in findings:
        if f["start"] >= at:
            out += [text[at:f["start"]], "[SECRET]"]
        at = max(at, f["end"])
    return "".join(out) + text[at:]
