"""The toxicity grammar on sentences, and what its context is worth on a planted set."""

import random

import pytest

from plumbline.llm import toxicity
from plumbline.llm.toxicity import GRAMMAR, INSULT, Lexicon, clauses_of, features_of, fit_logistic

LEXICON = {"idiot": 2.0, "moron*": 3.0, "scum": 5.0}


def weight(text):
    return round(sum(w for _, w, _ in clauses_of(text, Lexicon(LEXICON))), 6)


def test_target_on_either_side():
    assert weight("you kill") == weight("kill you") == 3.0 > weight("kill") == 0.3
    assert weight("I will kill you") == weight("you I will kill") == 4.5
    assert weight("you idiot") == weight("idiot, you") == 1.25 * INSULT["2"] > weight("an idiot")
    assert weight("he sat. An idiot. You") == weight("idiot")


def test_negation_with_either_apostrophe():
    assert weight("don't you idiot") == weight("don’t you idiot") == 0.4 * INSULT["2"]
    assert weight("no, you idiot") == weight("you idiot")


def test_reported_speech_over_a_colon_and_in_quotes():
    quiet = 0.4 * INSULT["2"]
    assert weight("he said: you are an idiot") == weight("he said you are an idiot") == quiet
    assert weight("he said: go on. You are an idiot") == weight("you are an idiot")
    assert weight('"fine" you idiot') == weight("“fine” you idiot") == weight("you idiot")
    assert weight('"well. you idiot." you see') == weight("„well. you idiot“") == quiet
    assert weight('an " open\nyou idiot') == weight("you idiot")


def test_strengths_and_stems():
    assert [weight(w) for w in ("idiot", "moronic", "scum")] == [INSULT[k] for k in "246"]


def test_composition_equals_the_transducers_in_a_row():
    rng = random.Random(1)
    for _ in range(300):
        symbols, state, got = rng.choices("123456TMGNRQCSo", k=30), 0, 0.0
        for x in symbols:
            state, more = GRAMMAR[state, x]
            got += more
        expected, row = 0.0, symbols
        for start, transducer in toxicity.TRANSDUCERS:
            own, out = start, []
            for x in row:
                own, x, more = transducer(own, x)
                out.append(x)
                expected += more
            row = out
        assert abs(got - expected) < 1e-9


@pytest.mark.parametrize("text", [None, "", " ", "!!! ...", '"', "’", "12 34", "é" * 10])
def test_texts_without_matches(text):
    assert features_of(text, Lexicon(LEXICON))[:5] == [0.0] * 5


def test_context_decides_on_a_planted_set(monkeypatch):
    """Toxic and clean documents of the same words: without the context rules they can't be told apart."""
    import numpy as np

    rng = random.Random(3)
    toxic = ["you are an idiot", "I will kill you", "you scum", "morons like you"]
    clean = ["he said: you are an idiot", 'they wrote "I will kill you"', "you are not scum", "nobody is a moron to you"]
    filler = ["the sun rose over the hills", "a train left the station", "we had bread and tea"]
    texts = [(". ".join([*rng.sample(filler, 2), rng.choice(part), rng.choice(filler)]), y)
             for y, part in ((1, toxic), (0, clean)) for _ in range(200)]
    rng.shuffle(texts)
    y = np.array([t[1] for t in texts], float)

    def right():
        x = np.array([features_of(t, Lexicon(LEXICON)) for t, _ in texts])
        mean, scale, coef = fit_logistic(x[:200], y[:200])
        return float((((x[200:] - mean) / scale @ coef[:-1] + coef[-1] > 0) == (y[200:] > 0)).mean())

    with_grammar = right()
    bare = toxicity.compose(*toxicity.TRANSDUCERS[2:])
    monkeypatch.setattr(toxicity, "GRAMMAR", bare)
    monkeypatch.setattr(toxicity, "BEGIN", (0, 0))
    assert with_grammar >= 0.95 and right() <= with_grammar - 0.05
