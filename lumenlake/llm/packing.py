"""Best-fit packing of tokenised documents into sequences, by merging what partitions could not fill.

Each partition tokenises its documents and packs their pieces best-fit, largest first, a bounded number at a
time. Sequences that are nearly full are done. The others become items themselves (a stretch of tokens
as long as their fill) and are packed best-fit again, groups of partitions merged like a tree, until one
group is left or merging gains nothing more. Only (sequence, fill) pairs take part in the later rounds.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, checkpoint, texts

#: Tokens in a sequence; the id that ends each document.
LENGTH, END = 2048, 0
#: Pieces packed at a time in a partition, and underfull sequences in one task of a later round.
AT_ONCE, IN_TASK = 100_000, 200_000
#: A sequence with at least this many tokens is done.
NEARLY = LENGTH - 8
#: Groups merged into one in each round.
FAN = 8

_encoders: dict[str, tiktoken.Encoding] = {}


def byte_tokens(tokenizer_path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE tokenizer file, each token as its bytes, in which every merge makes the next id.

    In such a file printable Latin-1 characters stand for their own bytes and characters from U+0100 on for the others in turn.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    own = [b for b in range(256) if chr(b).isprintable() and b != 32]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}
    ranks = {bytes(map(byte.__getitem__, token)): i for token, i in model["vocab"].items()}
    merges = [ranks[b"".join(bytes(map(byte.__getitem__, part)) for part in (m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
    if merges != [*range(256, 256 + len(merges))]:
        raise ValueError("ids do not follow the order of the merges")
    return ranks


def _encoder(path: str) -> tiktoken.Encoding:
    """One per Python worker: the tokenizer file's vocabulary in tiktoken, which gives the same ids in a fifth of the time."""
    if path not in _encoders:
        _encoders[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_tokens(path), special_tokens={})
    return _encoders[path]


def token_ids(text: str | None, tokenizer_path: str) -> np.ndarray:
    """32-bit ids of a text, as the tokenizer file gives them, the closing id last. Strings of special tokens are ordinary text."""
    return np.array([*_encoder(tokenizer_path).encode_ordinary(text or ""), END], "<u4")


def best_fit(sizes: Iterable[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """For each size, in the order given, its bin and its offset there; and each bin's fill.

    A size goes to the fullest bin that still takes it. Bins stand by room left, and the bits of ``rooms``
    say which amounts of room exist, so that each step costs the same however many bins there are.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, offsets, fills = 0, [], [], []
    for size in sizes:
        if fit := rooms >> size:
            room = size + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins.append(b)
        offsets.append(fills[b])
        fills[b] += size
        if left := room - size:
            stacks[left].append(b)
            rooms |= 1 << left
    return bins, offsets, fills


def packed_locally(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, bin, offset, fill (of its bin), and ids if asked for."""

    def run(batches: Batches) -> Batches:
        base, made = TaskContext.get().partitionId() << 33, 0
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal rows, made
            order = sorted(range(len(rows)), key=lambda k: -rows[k][3])
            bins, offsets, fills = best_fit((rows[k][3] for k in order), LENGTH)
            place = [(0, 0, 0)] * len(rows)
            for k, b, offset in zip(order, bins, offsets, strict=True):
                place[k] = base + made + b, offset, fills[b]
            made += len(fills)
            columns = [*zip(*((*row[:5], *place[k], row[5]) for k, row in enumerate(rows)), strict=True)] or [()] * 9
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "bin": pa.int64(), "offset": pa.int64(), "fill": pa.int64()}
            out = {name: pa.array(column, kind) for (name, kind), column in zip(kinds.items(), columns, strict=False)}
            if with_ids:
                out["ids"] = pa.array(columns[8], pa.list_(pa.int32()))
            rows = []
            return pa.record_batch(out)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    own = token_ids(text, tokenizer_path)
                    n = len(own)
                    start, stop = 0, n % LENGTH or min(n, LENGTH)
                    piece = 0
                    while start < n:
                        cut = own[start:stop]
                        rows.append((doc, piece, start, stop - start, zlib.crc32(cut), cut.astype("i4") if with_ids else None))
                        piece, start, stop = piece + 1, stop, stop + LENGTH
                if len(rows) >= AT_ONCE:
                    yield flush()
        yield flush()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"
    return texts(docs).mapInArrow(run, schema + ", ids array<int>" * with_ids)


def merge_underfull(bins: DataFrame, in_task: int = IN_TASK, fan: int = FAN) -> DataFrame:
    """bin, sequence_id, base for the underfull ``bins`` (bin, fill, part): where each one's tokens begin in which sequence."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fill", "sequence_id"], ascending=[False, True])
        into, offsets, fills = best_fit(rows["fill"].tolist(), LENGTH)
        ids = rows["sequence_id"].to_numpy()
        first = {b: ids[k] for k, b in reversed([*enumerate(into)])}  # a merged bin keeps the name of its first
        return pd.DataFrame(
            {"sequence_id": ids, "into": [first[b] for b in into], "shift": offsets, "filled": [fills[b] for b in into], "part": rows["part"].to_numpy()}
        )

    placed = bins.select("bin", F.col("bin").alias("sequence_id"), F.lit(0).cast("long").alias("base"))
    items = bins.select(F.col("bin").alias("sequence_id"), "fill", "part")
    left, groups, turn = items.count(), None, 0
    while left > 1:
        parts = items.agg(F.max("part")).first()[0] + 1 if groups is None else groups
        groups = max(math.ceil(parts / fan), math.ceil(left / in_task), 1)
        # neighbours are merged, as in a tree; once the count of groups stands still, by chance, anew each round
        group = F.floor(F.col("part") * groups / parts) if groups < parts else F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(groups))
        grouped = items.withColumn("part", group.cast("long"))
        moved = checkpoint(grouped.groupBy("part").applyInPandas(fit, "sequence_id long, into long, shift long, filled long, part long"))
        placed = checkpoint(
            placed.join(moved.select("sequence_id", "into", "shift"), "sequence_id", "left").select(
                "bin", F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("base") + F.coalesce("shift", F.lit(0))).alias("base")
            )
        )
        items = moved.filter((F.col("shift") == 0) & (F.col("filled") < NEARLY)).select(F.col("into").alias("sequence_id"), F.col("filled").alias("fill"), "part")
        before, left, turn = left, items.count(), turn + 1
        if groups == 1 or (groups >= parts and left > 0.99 * before):
            break
    return placed


def pack(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """A row per piece of at most 2,048 tokens with its place in a sequence.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for). A document is its
    tokens and the closing id, so null and empty texts are one token. Only longer documents are cut, the
    first piece taking the remainder. Repeated rows are packed like any others; an empty table gives no rows.
    """
    pieces = checkpoint(packed_locally(docs, tokenizer_path, with_ids))
    underfull = pieces.filter((F.col("offset") == 0) & (F.col("fill") < NEARLY)).select(
        "bin", "fill", F.shiftright("bin", 33).alias("part")
    )
    placed = merge_underfull(underfull).withColumnRenamed("bin", "own")
    return pieces.join(placed, pieces["bin"] == placed["own"], "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence_id", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
        *["ids"] * with_ids,
    )
