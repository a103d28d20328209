"""Letters that are spaced out, drawn out or doubled, under a trigram model of a few words."""

from collections import Counter
from itertools import groupby

import numpy as np
import pytest

from lumenlake.llm import toxicity

WORDS = "you are such a stupid man and i am no idiot they said hello to a moron in the letter of summer this is all of it".split()


def _counts():
    counts = np.zeros(27**3, np.int64)
    text = " " + " ".join(np.random.default_rng(0).choice(WORDS, 5000)) + " "
    x = [ord(c) - 96 if c != " " else 0 for c in text]
    for (a, b, c), n in Counter(zip(x, x[1:], x[2:], strict=False)).items():
        counts[a * 729 + b * 27 + c] = n
    return counts


COUNTS = _counts()


@pytest.fixture(scope="module")
def features():
    return toxicity.Features(toxicity.Channel(COUNTS))


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("s t u p i d", {"stupid"}), ("such a s t u p i d man", {"such", "stupid", "man"}), ("I i d i o t", {"idiot"}), ("s t u p i d m o r o n", {"stupid", "moron"}),
        ("s  t  u\tp\ni d", {"stupid"}), ("a s t u p 1 d man", {"stupid"}), ("i d d i o t", {"idiot"}), ("iddiot", {"idiot"}), ("letter summer", {"letter", "summer"}),
        ("st" + "u" * 60 + "pid", {"stupid"}), ("i" * 45 + "diot!", {"idiot"}), ("m.o.r.o.n", {"moron"}), ("stupid.moron", {"stupid", "moron"}),
        (" ".join("they" * 50) + " " + " ".join("idiot"), {"they", "idiot"}), ("-".join("suchastupidmoron" * 4), {"stupid", "moron"}),
        ("hello." * 30 + "$tup1d", {"hello", "stupid"}),
    ],
)
def test_hidden_words_are_features(features, text, words):
    assert words <= features.of(text)


def test_a_whole_text_of_spaced_letters(features):
    said = [*np.random.default_rng(1).choice([w for w in WORDS if len(w) > 3], 400)]
    read = features.channel.restore("".join(said), True).split()
    assert sum((Counter(read) & Counter(said)).values()) >= 0.95 * len(said)


def every_way(channel, runs, spaced, first=True, state=0):
    """cost, letters of all readings of ``runs`` in turn, from the definition of the channel."""
    if not runs:
        yield channel.cost[state][0], ""
        return
    sign, n = runs[0]
    kept = toxicity.SIGNS.get(sign, "") if not sign.isalpha() else sign
    price = 0.0 if sign.isalpha() else toxicity.SIGN_COST * n
    gaps = [""] if first or not spaced else ["", " "]
    ways = [(price + (0 if n == 1 else toxicity.DOUBLE_COST * (n < 3)), g + x) for x in kept for g in gaps]
    if n > 1:
        ways += [(price + toxicity.DOUBLE_COST * (n > 2), g + x + h + x) for x in kept for g in gaps for h in gaps]
    if sign in toxicity.SEPARATORS or not kept:
        ways += [(toxicity.SEPARATOR_COST * n, g) for g in ("", " ")]
    for cost, letters in ways:
        now = state
        for x in letters:
            code = 0 if x == " " else ord(x) - 96 if "a" <= x <= "z" else None
            cost += 0.0 if code is None else channel.cost[now][code]
            now = now % 27 * 27 + (code or 0)
        for more, rest in every_way(channel, runs[1:], spaced, False, now):
            yield cost + more, letters + rest


@pytest.mark.parametrize("spaced", [False, True])
@pytest.mark.parametrize("signs", ["st00pid", "i.d-i0t", "m*r#n", "l3tterr", "hell@@o", "a$$!", "é1x", "..a", "mmmooorrr", "1*1"])
def test_viterbi_finds_the_least_cost(features, signs, spaced):
    channel = features.channel
    runs = [(k, len([*own])) for k, own in groupby(signs)]
    ways = sorted(every_way(channel, runs, spaced))
    found = channel.restore(signs, spaced)
    assert min(cost for cost, letters in ways if letters == found) == pytest.approx(ways[0][0], abs=1e-9)


def test_scores_of_a_plain_version(spark, features):
    """Scores are those of the logistic model over the set of features, whatever the rows' order and batches."""
    known = sorted(features.of(" ".join(WORDS)))
    weights = np.random.default_rng(2).normal(size=len(known))
    model = toxicity.Model(COUNTS, known, weights, -0.5)
    texts = ["", None, "stupid", "a $tup1d m0r0n", "s t u p i d man " * 3, "nothing known", "stupid " * 5000]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    for n, text in enumerate(texts):
        z = -0.5 + sum(w for f, w in zip(known, weights, strict=True) if f in features.of(text))
        assert got[n] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)
