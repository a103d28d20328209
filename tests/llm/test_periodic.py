"""Runs against a search of all periods and places."""

import hashlib
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenlake.llm import periodic
from lumenlake.llm.queries import QUERIES


def plain_runs(words):
    """start, length, period of all runs: at each period the maximal stretches, without those that a smaller period has too."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            length = k + q - start
            smaller = any(words[start : start + length - d] == words[start + d : start + length] for d in range(1, q))
            if length >= max(24, 3 * q) and not smaller:
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_rows(doc, text, plant):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    exponent = 1000 * best[1] // best[2] if runs else None
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return doc, len(runs), *best, exponent, sha(listed), sha(" ".join(w for k, w in enumerate(words) if k not in gone))


def found(texts):
    return periodic._scan([" ".join(t).encode() for t in texts])[1]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_all_runs_are_found(seed):
    """Texts of runs of any period in each other and beside each other, with few words and many."""
    random = np.random.default_rng(seed)
    texts = []
    for _ in range(int(random.integers(1, 6))):
        letters = int(random.choice([1, 2, 3, 50]))
        words = []
        for _ in range(int(random.integers(0, 4))):
            base = random.integers(0, letters, random.integers(1, 40)).tolist()
            if random.random() < 0.5:  # a run within the period
                base += base[: max(1, len(base) // 3)] * int(random.integers(1, 5))
            words += (base * 12)[: int(random.integers(1, 5 * len(base)))]
            words += random.integers(0, letters, random.integers(0, 10)).tolist()
        for k in random.integers(0, max(1, len(words)), random.integers(0, 3)) if words else ():
            words[k] = 99
        texts.append([f"w{x}" for x in words])
    assert found(texts) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("period", [*range(1, 60), 97, 128, 170, 171, 256])
def test_every_period_at_its_least_length(period):
    random = np.random.default_rng(period)
    base = [f"b{k}" for k in random.integers(0, 10**6, period)]
    least = max(24, 3 * period)
    run = (base * 30)[: least]
    text = ["x", *run, "y"]
    assert found([text, text[:-2], ["z"] * 3, text]) == [[(1, least, period)], [], [], [(1, least, period)]]


def test_fibonacci_words_and_long_texts():
    a, b = "a", "ab"
    while len(b) < 900:
        a, b = b, b + a
    assert found([[*b], ["q"] * 700]) == [plain_runs([*b]), [(0, 700, 1)]]
    random = np.random.default_rng(1)
    base = [f"b{k}" for k in random.integers(0, 10**6, 30_000)]
    assert found([["x", *base * 4]]) == [[(1, 120_000, 30_000)]]
    assert found([["x"] * 300_000]) == [[(0, 300_000, 1)]]


def test_odd_rows(spark):
    again = "one two three " * 20
    rows = [(1, None), (2, ""), (3, " \n"), (4, again), (4, again), (None, again), (None, None), (5, "x " * 23), (6, "x " * 24), (7, "naïve \x85  " * 30), (8, " ".join(f"w{n}" for n in range(50_000)))]
    df = spark.createDataFrame([(d, t, "r", 3, "b", 1) for d, t in rows], "doc_id long, text string, runs string, n int, best string, h long")
    got = sorted(map(tuple, periodic.findings(periodic.periodic_runs(df)).collect()), key=repr)
    assert got == sorted((plain_rows(d, t, False) for d, t in rows), key=repr)
    planted = sorted(map(tuple, periodic.findings(periodic.periodic_runs(periodic.planted(df.filter("doc_id <> 8 or doc_id is null")))).collect()), key=repr)
    assert planted == sorted((plain_rows(d, t, True) for d, t in rows if d != 8), key=repr)
    assert periodic.findings(periodic.periodic_runs(periodic.planted(df.limit(0)))).count() == 0


def test_op13_on_the_smallest_tables(spark, sf_dir):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    got = sorted(map(tuple, QUERIES["op13_periodic_runs"](spark, sf_dir).collect()))
    short = [(d, t) for d, t in docs if len((t or "").split()) < 700 or zlib.crc32(str(d).encode()) % 10 == 0]  # the plain search takes the square of a text's words
    wanted = {r[0]: r for r in (plain_rows(d, t, True) for d, t in short)}
    assert len(got) == len(docs) and all(r == wanted[r[0]] for r in got if r[0] in wanted) and sum(r[1] for r in got) >= 15
