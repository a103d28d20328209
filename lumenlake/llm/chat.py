"""Chat formatting by columnar assembly of bytes.

All turns of a batch are laid out at once: the lengths of the segments (mark, role, line end, text, mark)
give offsets by a cumulative sum, and scatter indices copy the role headers and the texts from their
Arrow buffers into one preallocated buffer, which becomes the formatted column without another copy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches

#: What marks a turn: OPEN role line-end text CLOSE.
OPEN, CLOSE = b"<|turn|>", b"<|end|>\n"
#: What a text could use to pass for a mark, of this template or a common one. One more backslash after the first character tells it apart.
CONTROL = r"([<\[])(\\*)(\|(?:turn|end|im_start|im_end|endoftext|system|user|assistant)\|>|/?s>|/?INST\]|</?SYS>>|/?SYS>)"
#: Bytes of text from which on the turns of a conversation go on in a further row; turns that are laid out at once.
PIECE_BYTES, AT_ONCE = 8 << 20, 2000
#: Bytes from which on a segment is copied by itself.
LONG = 4096

_control, _escaped = re.compile(CONTROL), re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)"))


def escape(text: str) -> str:
    return _control.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1\2\3", text)


def _role(role: str | None) -> bytes:
    """A role on one line."""
    return escape((role or "").replace("\\", "\\\\").replace("\n", "\\n")).encode()


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def _scatter(out: np.ndarray, at: np.ndarray, source: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
    """Copies ``length[k]`` bytes of ``source`` from ``begin[k]`` to ``at[k]`` for all k; long segments need no indices."""
    long = length >= LONG
    for k in np.flatnonzero(long):
        out[at[k] : at[k] + length[k]] = source[begin[k] : begin[k] + length[k]]
    at, begin, length = at[~long], begin[~long], length[~long]
    ends = np.cumsum(length)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
    out[np.repeat(at, length) + within] = source[np.repeat(begin, length) + within]


def assemble(roles: list[str | None], content: pa.Array, first: np.ndarray, masked: str = "assistant") -> tuple[pa.Array, pa.Array, pa.Array]:
    """The formatted text of each conversation, and the code points at which its masked texts begin and end.

    ``first`` has the index of each conversation's first turn.
    """
    content = pc.fill_null(content.cast(pa.string()), "")
    if pc.any(marked := pc.match_substring_regex(content, CONTROL)).as_py():  # few: others are copied as they are
        fixed = pa.array([escape(x) for x in content.filter(marked).to_pylist()], pa.string())
        content = pc.replace_with_mask(content, marked, fixed)
    if isinstance(content, pa.ChunkedArray):
        content = content.combine_chunks()
    _, offsets, data = content.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(content) + 1, 4 * content.offset).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    kinds = {r: k for k, r in enumerate(dict.fromkeys(roles))}
    heads = [OPEN + _role(r) + b"\n" for r in kinds]
    head_length = np.array([len(h) for h in heads], np.int64)
    kind = np.array([kinds[r] for r in roles], np.int64)
    text_length = np.diff(offsets)
    begin = np.cumsum(head_length[kind] + text_length + len(CLOSE)) - (head_length[kind] + text_length + len(CLOSE))
    total = int((head_length[kind] + text_length + len(CLOSE)).sum())
    out = np.empty(total, np.uint8)
    _scatter(out, begin, np.frombuffer(b"".join(heads), np.uint8), (np.cumsum(head_length) - head_length)[kind], head_length[kind])
    body = begin + head_length[kind]
    _scatter(out, body, data, offsets[:-1], text_length)
    closes = np.full(len(roles), len(CLOSE), np.int64)
    _scatter(out, body + text_length, np.frombuffer(CLOSE, np.uint8), np.zeros(len(roles), np.int64), closes)
    starts = np.append(begin[first], total)
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(out))
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points before each byte
    mine = np.flatnonzero(np.array([r == masked for r in roles], bool))
    conversation = np.searchsorted(first, mine, side="right") - 1
    base = points[starts[conversation]]
    lists = np.append(np.searchsorted(mine, first), len(mine)).astype(np.int32)
    spans = (pa.array((points[x] - base).astype(np.int32)) for x in (body[mine], body[mine] + text_length[mine]))
    return formatted, *(pa.ListArray.from_arrays(pa.array(lists), s) for s in spans)


def _sizes(rows: pa.Table) -> np.ndarray:
    """Bytes of each text."""
    return pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy().astype(np.int64)


def _bounded(rows: pa.Table) -> Iterator[pa.Table]:
    """``rows`` in slices of at most AT_ONCE rows and, unless it is a single row, PIECE_BYTES of text."""
    ends, at = np.cumsum(_sizes(rows)), 0
    while at < rows.num_rows:
        before = ends[at - 1] if at else 0
        upto = min(max(at + 1, int(np.searchsorted(ends, before + PIECE_BYTES, side="right"))), at + AT_ONCE)
        yield rows.slice(at, upto - at)
        at = upto


def _cuts(ids: list, sizes: np.ndarray, piece: int) -> tuple[list[int], list[int]]:
    """Where pieces begin, and their numbers; the first one goes on with number ``piece``."""
    cuts, pieces, size = [0], [piece], 0
    for k, (conversation, more) in enumerate(zip(ids, sizes.tolist(), strict=True)):
        if k and conversation != ids[k - 1]:
            cuts.append(k)
            pieces.append(0)
            size = 0
        elif size >= PIECE_BYTES:
            cuts.append(k)
            pieces.append(pieces[-1] + 1)
            size = 0
        size += more
    return cuts, pieces


def format_chats(turns: DataFrame, masked: str = "assistant") -> DataFrame:
    """conv_id, piece, formatted, loss_begin, loss_end: the loss mask covers the masked role's (escaped) texts.

    ``turns`` has conv_id, turn, role, text. Turns are ordered by turn (null first), ties by role and text, so
    repeated rows are repeated turns. Null text is empty, a null role an empty one, a null conv_id a conversation of
    its own. Rows are sorted within Spark's partitions and read as a stream. A conversation is one row of piece 0; one of more than
    PIECE_BYTES has further rows, whose texts joined in order of ``piece`` are the conversation (positions of the mask are those
    within the row). So a task holds about that much of it, whatever its length.
    """

    def run(batches: Batches) -> Batches:
        held: pa.Table | None = None
        held_piece = 0
        schema = pa.schema({"conv_id": pa.int64(), "piece": pa.int32(), "formatted": pa.string(), "loss_begin": pa.list_(pa.int32()), "loss_end": pa.list_(pa.int32())})

        def emit(rows: pa.Table, cuts: list[int], pieces: list[int]) -> pa.RecordBatch:
            columns = assemble(rows.column("role").to_pylist(), rows.column("text").combine_chunks(), np.array(cuts, np.int64), masked)
            return pa.record_batch([rows.column("conv_id").combine_chunks().take(pa.array(cuts)), pa.array(pieces, pa.int32()), *columns], schema=schema)

        for batch in batches:
            for part in _bounded(pa.table(batch.columns, names=batch.schema.names)):
                rows = pa.concat_tables([held, part]) if held is not None else part
                cuts, pieces = _cuts(rows.column("conv_id").to_pylist(), _sizes(rows), held_piece)
                if len(cuts) > 1:  # the last piece may go on
                    yield emit(rows.slice(0, cuts[-1]), cuts[:-1], pieces[:-1])
                held, held_piece = rows.slice(cuts[-1]), pieces[-1]
        if held is not None and held.num_rows:
            yield emit(held, [0], [held_piece])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, piece int, formatted string, loss_begin array<int>, loss_end array<int>")


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """role, text of each turn of a formatted conversation."""
    opening, closing = OPEN.decode(), CLOSE.decode()
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(closing, line)
        yield _unrole(formatted[at + len(opening) : line]), unescape(formatted[line + 1 : end])
        at = end + len(closing)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all taken from the formatted rows.

    The pieces of a conversation follow each other in one partition, as ``format_chats`` returns them.
    """

    def run(batches: Batches) -> Batches:
        kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
        state: list | None = None

        def done(states: list[list]) -> pa.RecordBatch:
            columns = zip(*((i, n, a.hexdigest(), c, b.hexdigest(), f) for i, n, a, c, b, f in states), strict=True) if states else [()] * 6
            return pa.record_batch({k: pa.array(x, t) for (k, t), x in zip(kinds.items(), columns, strict=True)})

        for batch in batches:
            over = []
            for row in batch.to_pylist():
                if row["piece"] == 0:
                    over += [state] if state is not None else []
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for begin, end in zip(row["loss_begin"], row["loss_end"], strict=True):
                    said = unescape(text[begin:end])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            yield done(over)
        if state is not None:
            yield done([state])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
