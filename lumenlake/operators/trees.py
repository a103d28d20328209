"""Whole traces in a task: batches of whole traces from rows in order of traces, and what lies above and beneath in their trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iteration import cut

#: Spans of a trace that a task takes at once; larger traces go by joins. Groups of traces by a hash in which large ones are looked for first, and ids that are broadcast.
LARGE, GROUPS, IDS = 10_000, 1 << 20, 100_000


def by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Those of ``rows`` whose trace has up to LARGE of them, and the others, None if there are none.

    Rows are counted by a hash of the trace, which leaves little to shuffle; by trace only where a group has more than LARGE.
    """
    group = F.pmod(F.xxhash64("trace_id"), F.lit(GROUPS))
    crowded = cut(rows.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select("group"))
    if crowded.isEmpty():
        return rows, None
    near = rows.select("trace_id", group.alias("group")).join(F.broadcast(crowded), "group")  # at most GROUPS numbers
    large = cut(near.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select("trace_id"))
    if not (many := large.count()):
        return rows, None
    large = F.broadcast(large) if many <= IDS else large
    return rows.join(large, "trace_id", "left_anti"), rows.join(large, "trace_id", "left_semi")


def in_traces(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with those of a trace in one task, one after the other."""
    return rows.repartition("trace_id").sortWithinPartitions("trace_id", *order)


def whole_traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole traces from batches in order of traces."""
    kept: list[pa.RecordBatch] = []  # of one trace
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("trace_id")
        first = pc.index(ids, ids[-1]).as_py()
        if first or (kept and kept[0].column("trace_id")[0] != ids[-1]):
            yield from _joined([*kept, batch.slice(0, first)])
            kept = []
        kept.append(batch.slice(first))
    yield from _joined(kept)


def _joined(batches: list[pa.RecordBatch]) -> Iterator[pa.Table]:
    if any(b.num_rows for b in batches):
        yield pa.Table.from_batches(batches).combine_chunks()


def trace_numbers(ids: pa.ChunkedArray) -> np.ndarray:
    """Numbers from 0 of the traces of rows in order of traces."""
    coded = ids.combine_chunks().dictionary_encode() if isinstance(ids, pa.ChunkedArray) else ids.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64)


def span_numbers(trace: np.ndarray, spans: pa.Array, parents: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the ids of spans and of their parents, equal for equal ids of one trace; -1 for null and, of parents, for none."""
    flat = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (spans, parents)]
    coded = pa.concat_arrays(flat).dictionary_encode()
    ids = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    found = np.unique(np.tile(trace, 2) * (len(coded.dictionary) + 1) + ids, return_inverse=True)[1].reshape(-1)
    none = pc.equal(flat[1], "").fill_null(True).to_numpy(zero_copy_only=False)
    return np.where(ids[: len(trace)] < 0, -1, found[: len(trace)]), np.where(none, -1, found[len(trace) :])


def _spread(keys: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows in order of ``keys``, and where each of ``many`` keys begins."""
    order = np.argsort(keys, kind="stable")
    return order, np.searchsorted(keys[order], np.arange(many + 1))


def _of(order: np.ndarray, begins: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The rows of all of ``keys``."""
    sizes = begins[keys + 1] - begins[keys]
    return order[np.repeat(begins[keys] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


def above(span: np.ndarray, parent: np.ndarray, failed: np.ndarray) -> np.ndarray:
    """Whether each number is of an id above a ``failed`` span, through spans of any status. Every id is left once, so cycles end."""
    many = int(max(span.max(initial=-1), parent.max(initial=-1))) + 1
    linked = np.flatnonzero((span >= 0) & (parent >= 0))
    order, begins = _spread(span[linked], many)
    over, left = np.zeros(many, bool), np.zeros(many, bool)
    at = np.unique(span[failed & (span >= 0)])
    while len(at):
        left[at] = True
        found = np.unique(parent[linked[_of(order, begins, at)]])
        over[found] = True
        at = found[~left[found]]
    return over


def depth_first(trace: np.ndarray, span: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place (from 1) in its trace, depth, and whether it has children, of each row; siblings go as the rows do. The place is 0 in a parent cycle."""
    n = len(span)
    row = np.full(int(max(span.max(initial=-1), parent.max(initial=-1))) + 2, -1, np.int64)
    row[span[span >= 0]] = np.flatnonzero(span >= 0)
    row[-1] = -1
    up = row[parent]
    order, begins = _spread(up + 1, n + 1)
    levels, at = [], order[: begins[1]]
    while len(at):
        levels.append(at)
        at = _of(order, begins, at + 1)
    size, place, depth = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for at in levels[:0:-1]:
        np.add.at(size, up[at], size[at])
    for number, at in enumerate(levels):
        of = trace[at] if number == 0 else up[at]
        before = np.cumsum(size[at]) - size[at]
        begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        base = np.repeat(before[begin], np.diff(np.r_[begin, len(at)]))
        place[at] = (0 if number == 0 else place[of]) + 1 + before - base
        depth[at] = number
    return place, depth, begins[1:-1][np.arange(n)] < begins[2:][np.arange(n)] if n else np.zeros(0, bool)
