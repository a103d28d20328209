"""Toxicity scores of texts whose disguises are undone first by a noisy channel.

A word that may be disguised (digits or signs for letters, drawn-out letters, separators or spaces between
letters) is read as a lattice: each sign may stand for letters, each run for one or two, a separator or white
space between single characters for nothing or the end of a word. Viterbi search finds the letters most likely
under a character trigram model, counted over all documents, and what the channel does to them. The restored words are scored by a logistic model
over words and word beginnings, fitted to a bounded sample of labelled rows.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, as_bytes, checkpoint, stored, texts, texts_by_row, without_rows

#: What a sign may stand for. Fixed values.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou"}
#: Signs that may stand between the letters of a word and mean nothing.
SEPARATORS = ".-_*~'`^/\\"
#: Costs (minus log probabilities) of a sign for a letter, a separator for nothing, a long run for two letters instead of one (or two letters for one).
SIGN_COST, SEPARATOR_COST, DOUBLE_COST = 2.0, 1.0, 1.0
#: A sign that comes this often or oftener in a row costs as much as coming this often.
LONGEST = 8
#: Runs of signs that are settled at a time, and those after them that are looked at before.
SETTLED, AHEAD = 256, 64
#: Letters from which on a word is named by its digest and not remembered.
LONG = 64
#: Labelled rows that the classifier is fitted to at most, features it chooses at most, and rows a feature is in at least.
SAMPLE, FEATURES, SUPPORT = 20_000, 1024, 3
#: Word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6)
REMEMBERED = 300_000

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”‘’…–—"
_run = re.compile(r"(.)\1")
_same = re.compile(r"(.)\1*", re.S)
_plain_or_same = re.compile(r"(?:([a-zß-öø-ÿ])(?!\1))+|(.)\2*", re.S)
_NO_LETTERS = "".join(c for c in _EDGES if c not in SIGNS)
_spaced = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_letter = bytes(c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else 0 for c in range(256))


def trigram_counts(docs: DataFrame) -> DataFrame:
    """code, n: how often each three of 27 characters (a-z and everything else) follow each other in all texts. At most 27^3 rows."""

    def run(batches: Batches) -> Batches:
        total = np.zeros(27**3, np.int64)
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                x = np.frombuffer((b" " + text + b" ").translate(_letter), np.uint8).astype(np.int16)
                for k in range(0, len(x), 1 << 20):
                    y = x[max(0, k - 2) : k + (1 << 20)]
                    if len(y) > 2:
                        total += np.bincount(y[:-2] * 729 + y[1:-1] * 27 + y[2:], minlength=27**3)
        codes = np.flatnonzero(total)
        yield pa.record_batch({"code": pa.array(codes, pa.int32()), "n": pa.array(total[codes], pa.int64())})

    return texts(docs).select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


@functools.lru_cache(65_536)
def _readings(sign: str, run: int, spaced: bool) -> list[tuple[float, tuple[int, ...], str]]:
    """What ``run`` times ``sign`` may stand for: cost, codes (0: the end of a word, 27: a letter the model does not know) and letters."""
    choices = [(0.0, sign)] if sign.isalpha() else [(SIGN_COST * run, x) for x in SIGNS.get(sign, "")]
    gaps = ("", " ") if spaced else ("",)
    out = []
    for cost, x in choices:
        if run == 1:
            out += [(cost, gap + x) for gap in gaps]
        else:  # two are likelier two, more are likelier one
            out += [(cost + DOUBLE_COST * (run < 3), gap + x) for gap in gaps]
            out += [(cost + DOUBLE_COST * (run > 2), gap + x + between + x) for gap in gaps for between in gaps]
    if sign in SEPARATORS or not choices:
        out += [(SEPARATOR_COST * run, gap) for gap in ("", " ")]
    return [(cost, tuple(map(_code, letters)), letters) for cost, letters in out]


def _code(letter: str) -> int:
    return 0 if letter == " " else ord(letter) - 96 if "a" <= letter <= "z" else 27


def _same_or_plain(signs: str) -> tuple[str, int]:
    """A run of one sign and its length; letters that differ from their neighbours stay together, with length 0."""
    return (signs, 0) if len(signs) > 1 and signs[0] != signs[1] else (signs[0], len(signs))


class Channel:
    """Restores disguised words under a trigram model."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(27, 27, 27) + 0.0
        two, one = three.sum(0), three.sum((0, 1))
        one = (one + 1) / (one.sum() + 27)
        two = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)  # smoothed by the shorter context
        cost = -np.log((three + 20 * two) / (three.sum(2, keepdims=True) + 20)).reshape(729, 27)
        self.cost = np.pad(cost, ((0, 0), (0, 1))).tolist()  # letters the model does not know cost nothing

    @staticmethod
    def disguised(word: str) -> bool:
        return len(word) > 1 and (not word.isalpha() and any(map(str.isalpha, word)) or bool(_run.search(word)))

    def restore(self, signs: str, spaced: bool = False) -> str:
        """The most likely letters behind lower-case ``signs``, words apart by a space.

        A word may end at a separator; if the signs stood apart in the text (``spaced``), before any of them. Signs are settled
        SETTLED runs at a time, so that the memory for a string of any length is bounded.
        """
        runs = [_same_or_plain(x[0]) for x in (_same if spaced else _plain_or_same).finditer(signs)]
        at, state, made = 0, 0, []
        while at < len(runs):
            part, last = runs[at : at + SETTLED + AHEAD], at + SETTLED + AHEAD >= len(runs)
            steps = []  # for each run: state -> cost, letters, state before; a state is the last two codes
            paths = {state: 0.0}
            for k, (sign, run) in enumerate(part):
                options = _readings(sign, min(run, LONGEST), spaced and at + k > 0) if run else [(0.0, tuple(map(_code, sign)), sign)]
                if len(paths) == len(options) == 1:  # there is no choice, whatever it costs
                    (before,), (_, codes, letters) = paths, options[0]
                    now = before
                    for code in codes[-2:]:
                        now = now % 27 * 27 + code % 27
                    steps.append({now: (0.0, letters, before)})
                    paths = {now: 0.0}
                    continue
                best: dict[int, tuple[float, str, int]] = {}
                for before, cost in paths.items():
                    for more, codes, letters in options:
                        total, now = cost + more, before
                        for code in codes:
                            total += self.cost[now][code]
                            now = now % 27 * 27 + code % 27
                        if now not in best or total < best[now][0]:
                            best[now] = total, letters, before
                steps.append(best)
                paths = {now: x[0] for now, x in best.items()}
            on = min(paths, key=lambda s: (paths[s] + (self.cost[s][0] if last else 0.0), s))
            settled = len(part) if last else SETTLED
            letters = []
            for k in range(len(part) - 1, -1, -1):
                if k == settled - 1:
                    state = on
                if k < settled:
                    letters.append(steps[k][on][1])
                on = steps[k][on][2]
            made += reversed(letters)
            at += settled
        return "".join(made)


class Features(dict):
    """The features of a lower-case token, restored if need be: a tuple of words and beginnings, or of their numbers."""

    def __init__(self, channel: Channel, numbers: dict[str, int] | None = None):
        self.channel, self.numbers = channel, numbers

    def __missing__(self, token: str) -> tuple:
        word = token.strip(_EDGES)
        words = {word}
        for form in {word, token.strip(_NO_LETTERS)}:  # a sign at the edge may be a letter or not
            if self.channel.disguised(form):
                words.update(self.channel.restore(form).split())
        found = {f for w in words if len(w) > 2 for f in (_named(w), *(w[:k] + "*" for k in BEGINNINGS if len(w) > k))}
        out = tuple(found) if self.numbers is None else tuple(self.numbers[f] for f in found if f in self.numbers)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(token) <= LONG:
            self[token] = out
        return out

    def of(self, text: str | None) -> set:
        """All features of a text, each once. Letters spaced out are also read as words."""
        text = (text or "").lower()
        tokens = set(text.split())
        for run in _spaced.findall(text):
            tokens.update(self.channel.restore("".join(run.split()), True).split())
        out: set = set()
        for found in map(self.__getitem__, tokens):
            out.update(found)
        return out


def _named(word: str) -> str:
    """A word as a feature; a long one by its digest."""
    return word if len(word) <= LONG else xxhash.xxh3_128_hexdigest(word.encode("utf-8", "surrogatepass"))


_kept: dict[bytes, Features] = {}


def _digest(counts: np.ndarray, features: list[str] | None) -> bytes:
    """What tells the memories of two models apart: all trigram counts, and all features in order."""
    told = xxhash.xxh3_128(counts.astype("<i8").tobytes())
    told.update(repr(features).encode("utf-8", "surrogatepass"))
    return told.digest()


def _shared(key: bytes, counts: np.ndarray, numbers: dict[str, int] | None) -> Features:
    """One memory of tokens per Python worker and model."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = Features(Channel(counts), numbers)
    return _kept[key]


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of at most ``sample`` labelled rows, chosen by a hash of doc_id; equal texts once. Held-out rows are not among them."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = texts(docs).join(F.broadcast(chosen), "doc_id")  # bounded: ``sample`` pairs of numbers
    return rows.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("toxic").alias("toxic"))


def held_out():  # noqa: ANN201
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


class Model:
    """Trigram counts, chosen features with their weights, and the bias."""

    def __init__(self, counts: np.ndarray, features: list[str], weights: np.ndarray, bias: float):
        self.counts, self.features, self.weights, self.bias = counts, features, weights, bias
        self.numbers = {f: k for k, f in enumerate(features)}
        self.key = _digest(counts, features)


def fit_logistic(rows: list[np.ndarray], toxic: np.ndarray, features: int, penalty: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model over sets of feature numbers, by accelerated gradient steps."""
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    column = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    weights, bias = np.zeros(features), math.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5))
    first, second = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(row, weights[column], len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic
        gradient = np.append(np.bincount(column, error[row], features) + penalty * weights * 0.1, error.sum()) / max(1, len(rows))
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        change = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - change[:-1], bias - change[-1]
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The trigram model of all ``docs`` and a classifier of a bounded sample of ``labels``.

    To the driver come 27^3 counts, FEATURES features and the feature numbers of the sample's rows.
    """
    counts = np.zeros(27**3, np.int64)
    for code, n in trigram_counts(docs).collect():  # at most 27^3 rows
        counts[code] = n
    rows = checkpoint(training_sample(docs, labels, sample))
    key = _digest(counts, None)

    def gather(batches: Batches) -> Batches:
        of = _shared(key, counts, None).of
        for batch in batches:
            found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for f in of(text):
                    found[f][toxic > 0] += 1
            clean, bad = zip(*found.values(), strict=True) if found else ((), ())
            yield pa.record_batch({"feature": pa.array(found, pa.string()), "clean": pa.array(clean, pa.int64()), "bad": pa.array(bad, pa.int64())})

    known = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0))).first()
    odds = F.log((F.col("bad") + 0.5) / (known[1] + 1) / ((F.col("clean") + 0.5) / (known[0] - known[1] + 1)))
    summed = rows.mapInArrow(gather, "feature string, clean long, bad long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    telling = summed.filter(F.col("bad") >= SUPPORT).withColumn("weight", F.col("bad") * odds).filter("weight > 0")
    features = [r[0] for r in telling.orderBy(F.desc("weight"), "feature").limit(FEATURES).select("feature").collect()]
    numbers, numbered = {f: k for k, f in enumerate(features)}, _digest(counts, features)

    def number(batches: Batches) -> Batches:
        of = _shared(numbered, counts, numbers).of
        for batch in batches:
            found = [sorted(of(text)) for text in batch.column("text").to_pylist()]
            yield pa.record_batch({"toxic": batch.column("toxic"), "found": pa.array(found, pa.list_(pa.int32()))})

    known = rows.mapInArrow(number, "toxic int, found array<int>").toPandas()  # ``sample`` rows at most
    weights, bias = fit_logistic([np.asarray(x) for x in known["found"]], (known["toxic"] > 0).to_numpy(float), len(features))
    return Model(counts, features, weights, bias)


def score(docs: DataFrame, model: Model, row: Column | None = None) -> DataFrame:
    """doc_id, row (as in ``texts_by_row``), score of every whole text; null and empty texts get the score of a text without features."""
    weights, bias, counts, numbers, key = model.weights, model.bias, model.counts, model.numbers, model.key

    def run(batches: Batches) -> Batches:
        of = _shared(key, counts, numbers).of
        for batch in batches:
            z = [bias + float(weights[list(found)].sum()) if (found := of(text)) else bias for text in batch.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "score": pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))), pa.float64())})

    rows, kind = texts_by_row(docs, row)
    return rows.mapInArrow(run, f"doc_id long, row {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, score (0 to 1), predicted (1 if the score is 0.5 or more).

    Only texts enter a score; rows with a null doc_id are not held out. Repeated rows get equal scores. Without
    labels every score is that of the bias. No rows give none.
    """
    return score(docs, train(docs, labels)).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; columns as before. Only the names of their rows are shuffled."""
    docs, row = stored(docs)
    return without_rows(docs, row, checkpoint(score(docs, train(docs, labels), row).filter("score >= 0.5").select("row")))
