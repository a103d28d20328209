"""Runs of words that repeat with a period, by minimizers at many scales.

A run is a stretch of words with smallest period q (words q apart are equal) that no neighbouring word extends, at
least 3 q and 24 words long. At a scale s every stretch of s words has a hash, and of each window of w = s // 2 + 1 neighbouring stretches
the least hash is its minimizer. A scale serves the periods q from 3/4 s to s. In a run of such a period two
windows q apart are equal and lie inside, so their minimizers are equal and q apart; and a stretch of s >= q words recurs in a run only at
multiples of q. So the pair is among the neighbours in the list of equal minimizers, and no run is missed. (It would take two
stretches with one 64-bit hash within a document.) Each pair at such a distance is a stretch that repeats at once: it is extended word by word
both ways, once per run. Periods up to 8, too short for scales, are found by comparing all words with those q before.

The documents of a batch are scanned together, longest first, with a word of its own after each; a scale ends where they get too short for it.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, as_bytes, texts

#: Words and periods that a run has at least, and the longest period that is found by comparing words at its lag.
WORDS, PERIODS, SHORT = 24, 3, 8
#: Bytes of texts that are scanned together.
AT_ONCE = 4 << 20
#: Words that are compared at first when a run is extended.
_STEP = 64


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two columns."""
    z = x * np.uint64(0x9E3779B97F4A7C15) + (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _over(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """``least`` of each window of ``width``, by windows of 1, 2, 4, ... put together."""
    done, out = 1, x
    while 2 * done <= width:
        out = least(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return least(out[: len(out) - rest], out[rest:]) if rest else out


def _primes(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] * (n > 1)


def _smallest(x: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether the stretch of several periods has no smaller one; that would divide it."""
    return not any(np.array_equal(x[start : end - d], x[start + d : end]) for d in (period // f for f in _primes(period)))


def _agree(x: np.ndarray, at: int, other: int, limit: int, back: bool) -> int:
    """How many words from ``at`` and ``other`` on (or before them) are equal, ``limit`` at most."""
    found, step = 0, _STEP
    while found < limit:
        n = min(step, limit - found)
        if back:
            same = x[at - found - n : at - found][::-1] == x[other - found - n : other - found][::-1]
        else:
            same = x[at + found : at + found + n] == x[other + found : other + found + n]
        if not same.all():
            return found + int(np.argmin(same))
        found, step = found + n, step * 2
    return found


def find_runs(x: np.ndarray, lengths: list[int]) -> list[tuple[int, int, int]]:
    """start, end, period of all runs in ``x``: word numbers of documents with ``lengths`` in falling order, after each a number that is nowhere else."""
    runs = []

    def add(start: int, end: int, period: int) -> None:
        if end - start >= max(WORDS, PERIODS * period) and _smallest(x, start, end, period):
            runs.append((start, end, period))

    for q in range(1, SHORT + 1):
        same = np.flatnonzero(x[:-q] == x[q:])
        breaks = np.flatnonzero(np.diff(same) != 1)
        firsts, lasts = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(same) - 1]))
        for k in np.flatnonzero(lasts - firsts + 1 >= max(WORDS, PERIODS * q) - q) if len(same) else ():
            add(int(same[firsts[k]]), int(same[lasts[k]]) + 1 + q, q)

    ends, shortest = np.cumsum(np.asarray(lengths) + 1), -np.asarray(lengths)
    grams, size, low = _mixed(x.astype(np.uint64), np.uint64(1)), 1, SHORT + 1
    while lengths and lengths[0] >= PERIODS * low:
        s = low * 4 // 3
        stop = int(ends[np.searchsorted(shortest, -PERIODS * low, "right") - 1])
        while 2 * size <= s:
            grams = _mixed(grams[: len(grams) - size], grams[size:])
            size *= 2
        part = grams[: stop - size + 1]
        hashes = _mixed(part[: len(part) - (s - size)], part[s - size :])
        width = s // 2 + 1
        if len(hashes) >= width:
            least = _over(hashes, width, np.minimum)
            edge = np.zeros(width - 1, np.uint64)
            at = np.flatnonzero(hashes == _over(np.concatenate((edge, least, edge)), width, np.maximum))
            at = at[np.argsort(hashes[at], kind="stable")]
            apart = np.diff(at)
            near = np.flatnonzero((hashes[at[1:]] == hashes[at[:-1]]) & (apart >= low) & (apart <= s))
            seen: dict[int, int] = {}
            for m, q in sorted(zip(at[near].tolist(), apart[near].tolist(), strict=True)):
                if m < seen.get(q, 0):
                    continue
                start = m - _agree(x, m, m + q, m, True)
                end = m + q + _agree(x, m, m + q, stop - m - q, False)
                seen[q] = end - q
                add(start, end, q)
        low = s + 1
    return runs


def _scan(texts_: list[bytes]) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """Words of each text, and its runs (start, length, period) in order."""
    words = [text.split() for text in texts_]
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    number = defaultdict(count().__next__)
    parts, own = [], -1
    for k in order:
        parts.append(np.fromiter(map(number.__getitem__, words[k]), np.int64, len(words[k])))
        parts.append(np.array([own]))
        own -= 1
    lengths = [len(words[k]) for k in order]
    begins = np.cumsum([0, *(n + 1 for n in lengths)])
    runs = [[] for _ in words]
    for start, end, period in sorted(find_runs(np.concatenate(parts), lengths)) if parts else ():
        k = int(np.searchsorted(begins, start, "right")) - 1
        runs[order[k]].append((start - int(begins[k]), end - start, period))
    return words, [sorted(own, key=lambda r: (r[0], r[2])) for own in runs]


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that are in no run after its first period, joined by one space."""
    if runs:
        turns = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            turns[start + period] += 1
            turns[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(turns[:-1]) == 0)]
    return b" ".join(words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n (words), runs (start, length, period; by start, then period), collapsed: the text with each run cut to its first period.

    Words are what lies between ASCII white space; in ``collapsed`` they are joined by one space. Null and empty texts have no words, no runs and
    an empty ``collapsed``. Rows are on their own: equal rows give equal rows, an empty table none. Memory goes with the longest text.
    """

    def made(ids: list, texts_: list[bytes]) -> pa.RecordBatch:
        words, runs = _scan(texts_)
        collapsed = pa.array([_kept(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string(), safe=False)
        listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], pa.list_(_RUN))
        return pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(map(len, words), pa.int64()), "runs": listed, "collapsed": collapsed})

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, held, size = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                ids.append(doc)
                held.append(text)
                size += len(text)
                if size >= AT_ONCE:
                    yield made(ids, held)
                    ids, held, size = [], [], 0
            yield made(ids, held)

    return texts(docs).mapInArrow(run, "doc_id long, n long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: with h the crc32 of the doc_id's digits, every text with h % 10 = 0 gets a period in its words from one on.

    With g = h div 10, n words, a = g % n and p = 1 + (n - a) div (3 + g % 8), word i from a on becomes word a + (i - a) % p. Rows without doc_id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("h div 10")

    def turned(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = F.lit(1) + ((n - a) / (F.lit(3) + g % 8)).cast("int")
        again = F.slice(words, a + 1, p)
        left = n - a
        times = (left / p).cast("int")
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.flatten(F.array_repeat(again, times)), F.slice(again, F.lit(1), left - times * p)), " ")

    # within the function the words are a variable, split once
    words = F.array(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    text = F.get(F.transform(words, lambda w: F.when(F.size(w) > 0, turned(w))), 0)
    rows = texts(docs).withColumn("h", h)
    return rows.select("doc_id", F.when(F.col("h") % 10 == 0, F.coalesce(text, "text")).otherwise(F.col("text")).alias("text"))


def findings(runs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest length by period (ties: smallest start, then period), digests of all runs and of ``collapsed``."""

    def better(best: Column, run: Column) -> Column:
        more, as_much = run["length"] * best["period"], best["length"] * run["period"]
        first = (run["start"] < best["start"]) | ((run["start"] == best["start"]) & (run["period"] < best["period"]))
        return F.when(best.isNull() | (more > as_much) | ((more == as_much) & first), run).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = runs.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000L * best.length div best.period").alias("exponent_milli"), sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
