"""Fill-in-middle by block rotation in place, and back.

A text is cut twice between its tokens. In a bytearray of the text the sentinels go in at the cuts, prefix, middle and suffix
each behind its own; then two neighbouring blocks change places by three reversals: both blocks, then the whole. The
inverse rotation and taking out the sentinels give the exact text. Reversals and the scan for cuts go by stretches of STEP
bytes, so that a text needs no more memory than itself and its output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, as_bytes, texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of texts that are transformed, percent of these with the suffix first, and what comes before the doc_id in the hash.
RATE, SUFFIX_FIRST, SALT = 90, 20, "1:"
#: Bytes that are looked at or swapped at a time, and bytes of texts in a batch that leaves Python.
STEP, BATCH_BYTES = 1 << 20, 32 << 20


def token_starts(view: np.ndarray, low: int, high: int) -> np.ndarray:
    """Which of the bytes ``low`` to ``high`` begin a token: a run of A-Z and a-z, or any other code point."""
    part = view[max(low - 1, 0) : high]
    letter = ((part | 32) - 97) < 26  # bytes wrap around below 97
    if low:
        before, letter, part = letter[:-1], letter[1:], part[1:]
    else:
        before = np.concatenate(([False], letter[:-1]))
    return np.where(letter, ~before, (part & 0xC0) != 0x80)


def count_tokens(view: np.ndarray) -> list[int]:
    """Tokens that begin in each STEP of bytes."""
    return [int(np.count_nonzero(token_starts(view, k, min(k + STEP, len(view))))) for k in range(0, len(view), STEP)]


def cut_at(view: np.ndarray, counts: list[int], token: int) -> int:
    """The byte where a token begins; the length for the number of all tokens."""
    for k, count in enumerate(counts):
        if token < count:
            return k * STEP + int(np.flatnonzero(token_starts(view, k * STEP, min((k + 1) * STEP, len(view))))[token])
        token -= count
    return len(view)


def code_points(view: np.ndarray) -> int:
    return sum(int(np.count_nonzero((view[k : k + STEP] & 0xC0) != 0x80)) for k in range(0, len(view), STEP))


def reverse(view: np.ndarray, low: int, high: int) -> None:
    """Turn the bytes ``low`` to ``high`` around in place."""
    while high - low > 2 * STEP:
        left = view[low : low + STEP].copy()
        view[low : low + STEP] = view[high - STEP : high][::-1]
        view[high - STEP : high] = left[::-1]
        low, high = low + STEP, high - STEP
    view[low:high] = view[low:high][::-1].copy()


def rotate(data: bytearray, low: int, cut: int, high: int) -> None:
    """Exchange the blocks ``low`` to ``cut`` and ``cut`` to ``high`` in place."""
    view = np.frombuffer(data, np.uint8)
    reverse(view, low, cut)
    reverse(view, cut, high)
    reverse(view, low, high)


def chance(salt: str, doc: int | None) -> list[int]:
    digest = hashlib.sha256(f"{salt}{'' if doc is None else doc}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(text: bytes, doc: int | None) -> tuple[int, str, int | None, int | None, bytearray]:
    """Tokens, form (plain, psm, spm), code points of prefix and middle (None if plain), output."""
    view = np.frombuffer(text, np.uint8)
    counts = count_tokens(view)
    n, (h1, h2, h3, h4) = sum(counts), chance(SALT, doc)
    data = bytearray(text)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= RATE:
        return n, "plain", None, None, data
    first, second = (cut_at(view, counts, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    sizes = code_points(view[:first]), code_points(view[first:second])
    data[second:second] = SUFFIX
    data[first:first] = MIDDLE
    data[:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
    rotate(data, middle if form == "psm" else 0, suffix, len(data))
    return n, form, *sizes, data


def invert(output: bytes, form: str) -> bytearray:
    """The text that ``transform`` made ``output`` of. Each sentinel is in it once, so its place tells the cuts."""
    data = bytearray(output)
    if form == "plain":
        return data
    if form == "psm":
        low, cut = data.index(SUFFIX), data.index(MIDDLE)
    else:
        low, cut = 0, data.index(PREFIX)
    rotate(data, low, cut, len(data))
    middle, suffix = data.index(MIDDLE), data.index(SUFFIX)
    del data[suffix : suffix + len(SUFFIX)]
    del data[middle : middle + len(MIDDLE)]
    del data[: len(PREFIX)]
    return data


def _batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType]) -> Batches:
    """Record batches of ``rows``, whose last value is a text's bytes, of about BATCH_BYTES each."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = [*zip(*rows, strict=True)] or [()] * len(kinds)
        out = {name: pa.array(column, pa.binary() if kind == pa.string() and name == last else kind) for (name, kind), column in zip(kinds.items(), columns, strict=True)}
        return pa.record_batch(out | {last: out[last].cast(pa.string(), safe=False)})

    *_, last = kinds
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= BATCH_BYTES:
            yield made(held)
            held, size = [], 0
    yield made(held)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output of every whole text.

    Null texts are empty, which are plain, as are texts that hold a sentinel and a tenth of all, by the hash of their doc_id (null: no digits).
    Rows are on their own: equal rows give equal rows, an empty table none.
    """
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True)
            yield from _batches(((doc, *transform(text, doc)) for doc, text in rows), kinds)

    return texts(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs`` (of ``fill_in_middle``) with ``restored``: the text, from output and form alone."""
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string(), "restored": pa.string()}

    def run(batches: Batches) -> Batches:
        for batch in batches:
            given = [batch.column(name).to_pylist() for name in [*kinds][:5]]
            outputs = as_bytes(batch.column("output"))
            for part in _batches(((out, bytes(invert(out, form))) for out, form in zip(outputs, given[2], strict=True)), {"at": pa.binary(), "restored": pa.string()}):
                rows = part.num_rows
                made = {name: pa.array(given[k][:rows], kinds[name]) for k, name in enumerate([*kinds][:5])}
                given = [column[rows:] for column in given]
                yield pa.record_batch(made | {"output": part.column("at").cast(pa.string(), safe=False), "restored": part.column("restored")})

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"
    return outputs.select(*[*kinds][:6]).mapInArrow(run, schema)


def digests(outputs: DataFrame) -> DataFrame:
    """``outputs`` with the hex digests of output and restored text in place of the output."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restore(outputs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
