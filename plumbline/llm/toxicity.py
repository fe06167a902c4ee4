"""Operator 1: toxicity by a weighted finite-state pattern grammar over clauses.

A text is read as a string of symbols: 1 to 6 insults of that strength, T threat verb, M announcement
(will, going to), G target, N negation, R report verb, Q quotation mark, C comma or colon, S end of
a sentence, o other. Four transducers read it one after the other; each hands a symbol on and adds
a weight:

    reported speech   after R up to the end of the sentence, and between two Q, insults and threats
                      become quiet ones (a to f, t)
    negation          for three symbols after N, or up to C, likewise
    insult            weighs insults; more with a target in the sentence, before or after
    threat            weighs threats; much more with a target, before or after, most if announced

They are composed once into a single automaton whose transitions carry the summed weights.
Matched clauses are scored, never single words out of context; a document's score is a logistic
function of the sum, maximum and counts over its clauses. The insult lexicon (words and word
beginnings, with their strength by log odds) and the logistic function are learned from labelled
rows; the closed classes are fixed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import BROADCAST_IDS

# Closed word classes: English, German, French, Spanish.
TARGETS = frozenset("""you your yours he she him her they them their du dich dir dein deine ihr euch
sie er tu te toi ton ta vous votre il elle ils tus ti usted ustedes ellos ella""".split())
NEGATIONS = frozenset("""not no never isn't aren't wasn't don't doesn't nobody nicht kein keine nie
niemals ne pas jamais aucun nunca jamás ni sin""".split())
REPORTS = frozenset("""said says say wrote writes claimed claims called quoted quote reported sagte
sagt schrieb schreibt behauptet meinte dit écrit disait affirme dijo dice escribió afirma""".split())
THREATS = frozenset("""kill hurt destroy beat burn shoot stab strangle töten verletzen zerstören
schlagen erschießen tuer frapper détruire brûler matar golpear destruir quemar""".split())
ANNOUNCEMENTS = frozenset("""will shall gonna going i'll we'll werde werden vais va allons voy vamos""".split())
QUOTES = frozenset('"“”„«»')

STRENGTHS = (2.0, 2.5, 3.0, 3.5, 4.25)            # log odds from which an insult is of the second to sixth strength
INSULT = {"1": 1.75, "2": 2.25, "3": 2.75, "4": 3.25, "5": 3.875, "6": 4.75}
AIMED_INSULT = 1.25                               # times its weight
QUIET = {"1": "a", "2": "b", "3": "c", "4": "d", "5": "e", "6": "f", "T": "t"}  # reported or negated
QUIET_INSULT, QUIET_THREAT = 0.4, 0.1
THREAT, AIMED_THREAT, ANNOUNCED_THREAT = 0.3, 3.0, 4.5
NEGATION_SCOPE = 3

LABELLED = 20_000   # labelled rows that are read to learn, at most: a bound of the fit
LEXICON = 6_000     # insult words and beginnings, at most: a bound of the fit
STEMS = range(4, 10)
LIFT = 1.5          # least log odds of a lexicon entry
SUPPORT = 4         # least toxic documents of a lexicon entry
FEATURES = 6

_SENTENCE = re.compile(r"[.!?;]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"“”„«»,:]")


def plain(text: str) -> str:
    return text.lower().replace("’", "'")


# ---- transducers: (state, symbol) -> (state, symbol, weight), state 0 first -----------------

def reporting(state: int, symbol: str) -> tuple[int, str, float]:
    """States: 0 own words, 1 after a report verb, 2 in a quotation."""
    if symbol == "Q":
        return (0 if state == 2 else 2), "o", 0.0
    if symbol == "R":
        return state or 1, "o", 0.0
    if symbol == "S" and state == 1:
        return 0, symbol, 0.0
    return state, QUIET.get(symbol, symbol) if state else symbol, 0.0


def negating(state: int, symbol: str) -> tuple[int, str, float]:
    """The state is the number of symbols that the last negation still reaches."""
    if symbol == "N":
        return NEGATION_SCOPE, "o", 0.0
    if symbol in "CS":
        return 0, symbol, 0.0
    return max(0, state - 1), QUIET.get(symbol, symbol) if state else symbol, 0.0


def insulting(state: str, symbol: str) -> tuple[str, str, float]:
    """States: nothing, a target, or the strongest insult of the sentence that no target was named for."""
    if symbol == "S":
        return "", symbol, 0.0
    if symbol in INSULT:
        aimed = state == "G"
        return ("G" if aimed else max(state, symbol)), "o", INSULT[symbol] * (AIMED_INSULT if aimed else 1.0)
    if symbol in "abcdef":
        return state, "o", QUIET_INSULT * INSULT["123456"["abcdef".index(symbol)]]
    if symbol == "G":
        return "G", symbol, (AIMED_INSULT - 1) * INSULT[state] if state in INSULT else 0.0
    return state, symbol, 0.0


def threatening(state: tuple[bool, bool, bool], symbol: str) -> tuple[tuple[bool, bool, bool], str, float]:
    """States: whether the sentence has an announcement, a target, a threat that no target was named for."""
    announced, target, waiting = state
    full = ANNOUNCED_THREAT if announced else AIMED_THREAT
    if symbol == "S":
        return (False, False, False), "o", 0.0
    if symbol == "M":
        return (True, target, waiting), "o", 0.0
    if symbol == "T":
        return (announced, target, not target), "o", full if target else THREAT
    if symbol == "t":
        return state, "o", QUIET_THREAT
    if symbol == "G":
        return (announced, True, False), "o", full - THREAT if waiting else 0.0
    return state, "o", 0.0


TRANSDUCERS = ((0, reporting), (0, negating), ("", insulting), ((False, False, False), threatening))


def compose(*transducers) -> dict[tuple[int, str], tuple[int, float]]:
    """One automaton that does the work of all in a row, weights added; states are numbered as they are met."""
    start = tuple(state for state, _ in transducers)
    number, waiting, table = {start: 0}, [start], {}
    while waiting:
        states = waiting.pop()
        for symbol in "123456TMGNRQCSo":
            out, after, weight = symbol, [], 0.0
            for state, (_, transducer) in zip(states, transducers):
                state, out, more = transducer(state, out)
                after.append(state)
                weight += more
            key = tuple(after)
            if key not in number:
                number[key] = len(number)
                waiting.append(key)
            table[number[states], symbol] = number[key], weight
    return table


GRAMMAR = compose(*TRANSDUCERS)
#: The state a sentence begins with outside and inside a quotation: nothing else outlasts a sentence.
BEGIN = (0, GRAMMAR[GRAMMAR[0, "Q"][0], "S"][0])


class Lexicon:
    """Weights of insults by word and by beginning of a word."""

    def __init__(self, entries: dict[str, float]):
        self.words = {k: v for k, v in entries.items() if not k.endswith("*")}
        self.stems = {k[:-1]: v for k, v in entries.items() if k.endswith("*")}
        self.known: dict[str, str] = {}

    def symbol(self, word: str) -> str:
        """The symbol that the grammar reads for a word or mark."""
        if word in self.known:
            return self.known[word]
        if word in QUOTES:
            found = "Q"
        elif word in ",:":
            found = "C"
        elif word in REPORTS:
            found = "R"
        elif word in NEGATIONS:
            found = "N"
        elif word in THREATS:
            found = "T"
        else:
            weight = max([self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in STEMS if k < len(word))])
            found = ("123456"[sum(weight >= s for s in STRENGTHS)] if weight > 0 else "G" if word in TARGETS
                     else "M" if word in ANNOUNCEMENTS else "o")
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[word] = found
        return found


def clauses_of(text: str, lexicon: Lexicon) -> Iterator[tuple[int, float, list[str]]]:
    """For each sentence with words: their number, its weight, and the words matched as insult or threat.

    A quotation may hold several sentences, but ends with its line.
    """
    symbol = lexicon.symbol
    for line in plain(text).split("\n"):
        quoted = False
        for sentence in _SENTENCE.split(line):
            tokens = _WORD.findall(sentence)
            if not tokens:
                continue
            read = [symbol(w) for w in tokens]
            marks = read.count("Q")
            words = len(read) - marks - read.count("C")
            matched = [w for w, x in zip(tokens, read) if x in "123456T"]
            weight = 0.0
            if matched:
                state = BEGIN[quoted]
                for x in read:
                    state, more = GRAMMAR[state, x]
                    weight += more
            quoted ^= marks % 2 == 1
            if words:
                yield words, weight, matched


def features_of(text: str | None, lexicon: Lexicon) -> list[float]:
    """What the matched clauses of a text add up to.

    Sum and maximum of clause weights, matched clauses, their share of all, distinct matched
    words, sum per hundred words.
    """
    if not isinstance(text, str) or not text:
        return [0.0] * FEATURES
    total, most, hits, clauses, words = 0.0, 0.0, 0, 0, 0
    distinct: set[str] = set()
    for n, weight, matched in clauses_of(text, lexicon):
        clauses += 1
        words += n
        if matched:
            total, most, hits = total + weight, max(most, weight), hits + 1
            distinct.update(matched)
    return [np.log1p(total), most, np.log1p(hits), hits / max(clauses, 1), np.log1p(len(distinct)),
            np.log1p(100 * total / max(words, 20))]


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 400):
    """Mean, scale and coefficients (the last is the constant) by Newton steps with a ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    coef = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ coef, -30, 30)))
        slope = z.T @ (p - y) + 0.5 * np.append(coef[:-1], 0)
        curve = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + 0.5 * np.eye(z.shape[1])
        coef -= np.linalg.solve(curve, slope)
    return mean, scale, coef


def _unit_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each half and label that hold a word, or a word with some beginning."""
    counts = {(half, toxic): Counter() for half in (0, 1) for toxic in (0, 1)}

    def flush():
        rows = [(u, h, counts[h, 1][u], counts[h, 0][u]) for h in (0, 1) for u in set(counts[h, 0]) | set(counts[h, 1])]
        for held in counts.values():
            held.clear()
        return pd.DataFrame(rows, columns=["unit", "half", "toxic", "clean"])

    for batch in batches:
        for text, toxic, half in zip(batch["text"], batch["toxic"], batch["half"]):
            words = set(_WORD.findall(plain(text)))
            units = {w for w in words if len(w) > 2}
            units.update(w[:k] + "*" for w in words for k in STEMS if k < len(w))
            counts[int(half), int(toxic > 0)].update(units)
            if sum(map(len, counts.values())) > 400_000:
                yield flush()
    yield flush()


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", folds: int = 5, held_out: int = 0,
                   labelled: int = LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``df``.

    Learns from labelled rows whose crc32(id as text) modulo ``folds`` is not ``held_out``; at
    most ``labelled`` of them, the least by a hash of the id, are read. Only the whole text enters a score. NULL and empty texts score as a text
    without matches. Rows with a NULL id are scored, never learned from. Repeated labels of an id
    are used once (the larger label counts); NULL labels are left out. Without both labels every
    score is the share of toxic rows learned from (0 without any). Further columns are ignored.
    """
    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    part = F.crc32(F.col("doc_id").cast("string")) % folds
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
             .filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(part != held_out)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .withColumn("toxic", (F.col("toxic") > 0).cast("int"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(min(labelled, BROADCAST_IDS)))
    train = (base.join(F.broadcast(known), "doc_id").filter("text IS NOT NULL")
             .withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))))
    lexicon, model, share = _learn(train)
    entries = {**lexicon}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Lexicon(entries)
        for batch in batches:
            out = batch[["doc_id", "held_out"]].copy()
            if model is None:
                out["score"] = share
            else:
                mean, scale, coef = model
                x = (np.array([features_of(t, own) for t in batch["text"]]).reshape(-1, FEATURES) - mean) / scale
                out["score"] = 1 / (1 + np.exp(-np.clip(x @ coef[:-1] + coef[-1], -30, 30)))
            out["predicted"] = (out["score"] >= 0.5).astype("int32")
            yield out

    kind = dict(base.dtypes)["doc_id"]
    return base.select("doc_id", F.coalesce(part == held_out, F.lit(False)).alias("held_out"), "text").mapInPandas(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def _lexicon(units: list, toxic: str, clean: str, sizes: tuple[int, int], support: int) -> dict[str, float]:
    """Entries with enough toxic documents and log odds, the strongest ones when there are many."""
    found = {}
    for r in units:
        odds = np.log((r[toxic] + 0.3) / (sizes[1] + 0.6)) - np.log((r[clean] + 0.3) / (sizes[0] + 0.6))
        if r[toxic] >= support and odds >= LIFT:
            found[r.unit] = float(odds)
    return found


def _learn(train: DataFrame):
    """Lexicon of all learned rows and the logistic function.

    The function is fitted on features that each half of the rows gets by the other half's
    lexicon, so that no row is scored by words that were picked because of it.
    """
    sizes = {(r.half, r.toxic): r.n for r in train.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sum(n for (_, t), n in sizes.items() if t) / max(1, sum(sizes.values()))
    if not all(sizes.get(k) for k in ((0, 0), (0, 1), (1, 0), (1, 1))):
        return {}, None, float(share)
    counts = train.select("text", "toxic", "half").mapInPandas(
        _unit_counts, "unit string, half int, toxic long, clean long")
    part = [F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}")
            for h in (0, 1) for c in ("toxic", "clean")]
    clean, toxic = (sizes[0, t] + sizes[1, t] for t in (0, 1))
    both = F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1")
    odds = F.log((both[0] + 0.3) / (toxic + 0.6)) - F.log((both[1] + 0.3) / (clean + 0.6))
    units = (counts.groupBy("unit").agg(*part).withColumn("toxic", both[0]).withColumn("clean", both[1])
             .filter(F.col("toxic") >= SUPPORT).withColumn("odds", odds).filter(F.col("odds") >= LIFT / 2)
             .orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "unit").limit(LEXICON).collect())
    lexicon = _lexicon(units, "toxic", "clean", (clean, toxic), SUPPORT)
    halves = [_lexicon(units, f"toxic{h}", f"clean{h}", (sizes[h, 0], sizes[h, 1]), SUPPORT // 2) for h in (0, 1)]

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [Lexicon(h) for h in halves]
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [
                features_of(t, own[1 - h]) for t, h in zip(batch["text"], batch["half"])]})

    rows = train.select("text", "toxic", "half").mapInPandas(features, "toxic int, x array<double>").collect()
    rows.sort(key=lambda r: (r.toxic, r.x))
    return lexicon, fit_logistic(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)), float(share)
