"""Exact dedup by recipes of content-defined chunks.

A text with its white space normalised is cut where a rolling hash of its last 32 bytes says so, which
depends on content alone. Chunks are deduplicated to a dictionary in which every identifier is verified
to stand for one chunk. A document is then its ordered list of identifiers; two documents are equal
exactly if their lists are. Long texts move at most once, as chunks into the dictionary, and copies of a
chunk in one task not at all; grouping and joining move only identifiers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, as_bytes, checkpoint, stored, texts, texts_by_row, without_rows

#: Chunk sizes in bytes: no boundary before LEAST, on average every 1,024 bytes after it, one at MOST.
LEAST, MASK, MOST = 512, 0x3FF, 8192
_SPACE = frozenset(b" \t\n\x0b\x0c\r")
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)

#: Identifiers, tried in this order until the dictionary shows no two chunks under one of them.
DIGESTS: dict[str, Callable[[bytes], bytes]] = {
    "xxh3_128": lambda x: xxhash.xxh3_128_digest(x),
    "sha256": lambda x: hashlib.sha256(x).digest(),
    "sha512": lambda x: hashlib.sha512(x).digest(),
}


def normalise(text: bytes) -> bytes:
    """Each run of the six ASCII white-space characters becomes one space, also at the ends."""
    if not text:
        return text
    words = text.split()
    if not words:
        return b" "
    return b" " * (text[0] in _SPACE) + b" ".join(words) + b" " * (text[-1] in _SPACE)


def boundaries(text: bytes) -> list[int]:
    """Ends of the chunks of ``text``; they cover it. Empty text has none."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    ends, start, piece = [], 0, 1 << 20  # a megabyte at a time, so that long texts need little memory
    for begin in range(0, n, piece):
        low = max(0, begin - 31)
        h = _GEAR[np.frombuffer(text, np.uint8, min(n, begin + piece) - low, low)]
        for width in (1, 2, 4, 8, 16):  # sums over 2, 4, ..., 32 bytes
            h[width:] += h[:-width] << np.uint32(width)
        for end in (np.flatnonzero((h[begin - low :] >> np.uint32(16)) & np.uint32(MASK) == 0) + begin + 1).tolist():
            while end - start > MOST:
                start += MOST
                ends.append(start)
            if end - start >= LEAST:
                ends.append(end)
                start = end
    while n - start > MOST:
        start += MOST
        ends.append(start)
    return [*ends, n] if start < n else ends


def chunks(text: bytes) -> list[bytes]:
    start, out = 0, []
    for end in boundaries(text):
        out.append(text[start:end])
        start = end
    return out


def dictionary(docs: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """Each different chunk once with its identifier: id, chunk."""

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            ids, parts, size, seen = [], [], 0, set()
            for text in as_bytes(batch.column("text")):
                for part in chunks(normalise(text)):
                    if (i := digest(part), part) not in seen:
                        seen.add((i, part))
                        ids.append(i)
                        parts.append(part)
                        size += len(part)
                if size > 8 << 20:
                    yield pa.record_batch({"id": pa.array(ids, pa.binary()), "chunk": pa.array(parts, pa.binary())})
                    ids, parts, size, seen = [], [], 0, set()
            yield pa.record_batch({"id": pa.array(ids, pa.binary()), "chunk": pa.array(parts, pa.binary())})

    return texts(docs).select("text").mapInArrow(cut, "id binary, chunk binary").distinct()


def verified_digest(docs: DataFrame, digests: dict[str, Callable[[bytes], bytes]] | None = None) -> Callable[[bytes], bytes]:
    """The first digest under which every identifier stands for exactly one chunk of ``docs``."""
    for digest in (digests or DIGESTS).values():
        shared = dictionary(docs, digest).groupBy("id").count().filter("count > 1")
        if shared.limit(1).count() == 0:
            return digest
    raise ValueError("different chunks share an identifier under every digest")


def recipes(docs: DataFrame, digest: Callable[[bytes], bytes], row: Column | None = None) -> DataFrame:
    """A row per document: doc_id, row, recipe (identifiers in order), text_sha256 (normalised text).

    ``row`` is the given one; without it, Spark's partition-wise row number, which another read may deal otherwise.
    """

    def cook(batches: Batches) -> Batches:
        for batch in batches:
            made, shas = [], []
            for text in map(normalise, as_bytes(batch.column("text"))):
                made.append(b"".join(map(digest, chunks(text))))
                shas.append(hashlib.sha256(text).hexdigest())
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "recipe": pa.array(made, pa.binary()), "text_sha256": pa.array(shas, pa.string())}
            )

    rows, kind = texts_by_row(docs, row)
    return rows.mapInArrow(cook, f"doc_id long, row {kind}, recipe binary, text_sha256 string")


def _first() -> Column:
    """What orders the rows of a group: smallest doc_id, null ids last, then the row number."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row"))


def exact_duplicates(docs: DataFrame, digests: dict[str, Callable[[bytes], bytes]] | None = None) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text is empty; all empty texts are one group. Of equal texts the smallest doc_id stays (a null
    id only if there is no other); of repeated rows with that id exactly one stays. An empty table gives
    no rows. Other columns of ``docs`` are ignored.
    """
    rows = checkpoint(recipes(docs, verified_digest(docs, digests)))
    groups = checkpoint(rows.groupBy("recipe").agg(_first().alias("first"), F.count(F.lit(1)).alias("group_size")))
    return rows.join(groups, "recipe").select(
        "doc_id",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one that ``exact_duplicates`` keeps; columns as before.

    Rows are named by file and place in it, which no other split of the files changes. Texts are not shuffled,
    only the names of the rows that go, which an anti join removes.
    """
    docs, row = stored(docs)
    rows = checkpoint(recipes(docs, verified_digest(docs), row))
    groups = checkpoint(rows.groupBy("recipe").agg(_first().alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return without_rows(docs, row, rows.join(groups, "recipe").filter(F.col("row") != F.col("first.row")))
