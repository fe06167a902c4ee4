"""Operator 8: language identification with error-correcting output codes.

Each language gets a codeword of +1 and -1; one binary classifier per bit is learned on hashed
letter n-grams. A text goes to the language whose codeword has the least loss, each bit weighted
by how reliable its classifier was on rows kept back from the fit, and is flagged as ambiguous
when the runner-up is close.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import bound_batches

FEATURES = 4096
SAMPLE = 2_400     # labelled rows the classifiers are fitted on, over all languages
UNDETERMINED = "und"


_TABLE: dict[str, np.ndarray] = {}  # built once in each worker


def _letters() -> np.ndarray:
    if "letters" not in _TABLE:
        _TABLE["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)], bool)
    return _TABLE["letters"]


def ngram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Relative frequencies of hashed bigrams and trigrams of letters, and the letter counts.

    Runs of anything but letters count as one blank. Long texts are added up piece by piece.
    """
    out = np.zeros((len(texts), FEATURES), np.float32)
    letters = np.zeros(len(texts), np.int64)
    table = _letters()
    for row, text in enumerate(texts):
        if not isinstance(text, str):
            continue
        for begin in range(0, len(text), 1 << 20):
            # Two code points more, so that a trigram across the border is seen once.
            piece = text[begin:begin + (1 << 20) + 2].lower()
            codes = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
            real = table[codes]
            letters[row] += int(real.sum())
            codes = np.where(real, codes, 32).astype(np.uint32)
            codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])] if len(codes) else codes
            codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]])
            two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
            three = two[:-1] * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
            for grams in (two, three):
                out[row] += np.bincount(grams >> np.uint32(20), minlength=FEATURES)
    total = np.maximum(out.sum(axis=1, keepdims=True), 1)
    return np.sqrt(out / total), letters


def codewords(count: int) -> np.ndarray:
    """One row of +1/-1 per language: all splits for up to five, else spread random splits."""
    if count < 2:
        return np.ones((count, 0), np.int8)
    if count <= 5:
        bits = np.arange(1, 2 ** (count - 1))
        rows = (bits[None, :] >> np.arange(count)[::-1][1:, None]) & 1
        return np.vstack([np.zeros((1, len(bits)), int), rows]).astype(np.int8) * -2 + 1
    length = max(15, int(np.ceil(10 * np.log2(count))))
    best, distance = None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (count, length))
        far = min(int((code[i] != code[j]).sum()) for i in range(count) for j in range(i))
        if far > distance and (np.abs(code.sum(axis=0)) < count).all():
            best, distance = code, far
    return best


def fit(features: np.ndarray, labels: np.ndarray, languages: list[str], rounds: int = 150):
    """Weights (features x bits), biases, bit weights and codewords."""
    code = codewords(len(languages))
    index = np.searchsorted(languages, labels)
    kept_back = np.arange(len(labels)) % 5 == 0
    target = code[index].astype(np.float32)
    share = np.bincount(index, minlength=len(languages)).astype(np.float32)
    weight = (1 / share[index])[:, None] * len(labels) / len(languages)
    x, y, w = features[~kept_back], target[~kept_back], weight[~kept_back]
    coef, bias = np.zeros((features.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    step, velocity = 4.0, np.zeros_like(coef)
    for _ in range(rounds):
        slope = -y * w / (1 + np.exp(np.clip(y * (x @ coef + bias), -30, 30))) / max(1, len(x))
        velocity = 0.9 * velocity - step * (x.T @ slope + 1e-5 * coef)
        coef += velocity
        bias -= step * 0.1 * slope.sum(axis=0)
    margins = features[kept_back] @ coef + bias
    right = ((np.sign(margins) == target[kept_back]) * weight[kept_back]).sum(axis=0) + 1
    bits = np.clip(right / (weight[kept_back].sum() + 2), 0.501, 0.999)
    reliability = np.log(bits / (1 - bits))
    return coef, bias, (reliability / max(reliability.sum(), 1e-9)).astype(np.float32), code


def decode(margins: np.ndarray, reliability: np.ndarray, code: np.ndarray):
    """Index of the nearest codeword, its probability and the runner-up's."""
    if code.shape[0] == 1:
        return np.zeros(len(margins), int), np.ones(len(margins)), np.zeros(len(margins))
    loss = np.stack([(np.logaddexp(0, -margins * row) * reliability).sum(axis=1) for row in code], axis=1)
    chance = np.exp(-code.shape[1] * (loss - loss.min(axis=1, keepdims=True)))
    chance /= chance.sum(axis=1, keepdims=True)
    order = np.argsort(-chance, axis=1, kind="stable")
    rows = np.arange(len(margins))
    return order[:, 0], chance[rows, order[:, 0]], chance[rows, order[:, 1]]


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL for a NULL id."""
    return F.crc32(id_col.cast("string")) % folds


def identify_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                      folds: int = 4, held_out: int = 2, ambiguous_below: float = 0.2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` for every row of ``df``.

    Learns from rows with an id, a text and a language whose fold is not ``held_out``, from a
    sample of ``SAMPLE`` rows chosen by a hash of the id, equal shares per language. Scores whole
    texts. ``score`` is the probability of the language; ``ambiguous`` marks texts whose best and
    second language are less than ``ambiguous_below`` apart. A NULL or empty text, or one without
    a letter, is ``und`` with score 0. A NULL id is never held out. Without a labelled row
    everything is ``und``. Repeated rows each get a row; further columns are ignored.
    """
    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                     F.col(lang_col).cast("string").alias("lang")).withColumn(
        "held_out", F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False)))
    train = base.filter("NOT held_out AND doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    schema = "doc_id " + dict(base.dtypes)["doc_id"] + ", held_out boolean, lang_pred string, score double, ambiguous boolean"
    predict = learn_predictor(train)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["doc_id", "held_out"]].copy()
            out["lang_pred"], out["score"], second = predict(batch["text"].tolist())
            out["ambiguous"] = (out["lang_pred"] != UNDETERMINED) & (out["score"] - second < ambiguous_below)
            yield out

    return base.select("doc_id", "held_out", "text").mapInPandas(run, schema)


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    folds: int = 4, held_out: int = 2) -> DataFrame:
    """The rows of ``df`` whose language can be told; rows that would be ``und`` go.

    Learns from the labelled rows of ``df`` itself, as ``identify_language`` does.
    """
    bound_batches(df.sparkSession)
    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                     F.col(lang_col).cast("string").alias("lang"))
    train = base.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").filter(
        fold_of(F.col("doc_id"), folds) != held_out)
    predict = learn_predictor(train)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, _, _ = predict(batch[text_col].tolist())
            yield batch[found != UNDETERMINED]

    return df.mapInPandas(run, df.schema)


def learn_predictor(train: DataFrame):
    """A function from texts to languages, their probabilities and those of the runners-up."""
    counts = {r.lang: r.n for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    model = _learn(train, counts, languages) if languages else None

    def predict(texts: list[str | None]):
        names = np.full(len(texts), UNDETERMINED, object)
        first, second = np.zeros(len(texts)), np.zeros(len(texts))
        for begin in range(0, len(texts) if model is not None else 0, 256):
            part = slice(begin, begin + 256)
            x, letters = ngram_counts(texts[part])
            coef, bias, reliability, code = model
            best, score, runner_up = decode(x @ coef + bias, reliability, code)
            told = letters > 0
            names[part] = np.where(told, np.array(languages, object)[best], UNDETERMINED)
            first[part], second[part] = np.where(told, score, 0.0), np.where(told, runner_up, 0.0)
        return names, first, second

    return predict


def _learn(train: DataFrame, counts: dict[str, int], languages: list[str]):
    """Fit on about ``SAMPLE`` rows, the same number of each language as far as there are any."""
    share = max(1, SAMPLE // len(languages))
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(8)), F.lit(1 << 40)) / float(1 << 40)
    chosen = train.join(F.broadcast(train.sparkSession.createDataFrame(
        [(name, share / n) for name, n in counts.items()], "lang string, rate double")), "lang").filter(part < F.col("rate"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, n = ngram_counts(batch["text"].tolist())
            keep = n > 0
            yield pd.DataFrame({"doc_id": batch["doc_id"][keep].astype(str), "lang": batch["lang"][keep],
                                "x": [row.astype(np.float16).tobytes() for row in x[keep]]})

    rows = chosen.select("doc_id", "lang", "text").mapInPandas(features, "doc_id string, lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.lang))
    x = np.stack([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32)
    return fit(x, np.array([r.lang for r in rows]), languages)
