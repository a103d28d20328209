"""Conversations are one row each; only one of many bytes is cut, and its pieces joined are the whole."""

import numpy as np
import pyarrow as pa

from lumenlake.llm import chat


def test_ten_thousand_turns_are_one_row(spark):
    turns = [(1, n, "assistant" if n % 2 else "user", f"said {n}") for n in range(10_000)] + [(2, 0, "user", "short")]
    rows = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["conv_id"], r["piece"]) for r in rows) == [(1, 0), (2, 0)]
    whole = next(r for r in rows if r["conv_id"] == 1)
    assert [said for _, said in chat.parse(whole["formatted"])] == [f"said {n}" for n in range(10_000)]
    assert [whole["formatted"][a:b] for a, b in zip(whole["loss_begin"], whole["loss_end"], strict=True)] == [f"said {n}" for n in range(1, 10_000, 2)]


def test_pieces_joined_are_the_whole():
    sizes = np.array([3, 0, chat.PIECE_BYTES, 1, 2, chat.PIECE_BYTES + 5, 7])
    assert chat._cuts([1, 1, 1, 1, 2, 2, 2], sizes, 4) == ([0, 3, 4, 6], [4, 5, 0, 1])
    assert chat._cuts([None, None], sizes[:2], 0) == ([0], [0])
    table = pa.table({"text": ["x" * n for n in (5, chat.PIECE_BYTES + 1, 1, 1)] + [None] * (chat.AT_ONCE + 1)})
    parts = [*chat._bounded(table)]
    assert pa.concat_tables(parts).equals(table) and all(p.num_rows <= chat.AT_ONCE for p in parts)
    assert all(p.num_rows == 1 or chat._sizes(p).sum() <= chat.PIECE_BYTES for p in parts)


def test_long_and_short_segments_are_laid_out_alike():
    texts = ["é" * 5000, "", "short", "x" * 4095, "y" * 4096, None]
    formatted, begin, end = chat.assemble(["user", "assistant"] * 3, pa.array(texts), np.array([0, 2]))
    told = [t for f in formatted.to_pylist() for t in chat.parse(f)]
    assert told == [(r, t or "") for r, t in zip(["user", "assistant"] * 3, texts, strict=True)]
    masked = [f[a:b] for f, x, y in zip(formatted.to_pylist(), begin.to_pylist(), end.to_pylist(), strict=True) for a, b in zip(x, y, strict=True)]
    assert masked == ["", "x" * 4095, ""]
