"""Byte-level BPE encoding by longest matches with backtracking, and decoding.

For each piece of text the longest vocabulary entry at the next byte is tried first, found by an
Aho-Corasick automaton over the piece (its bytes read as Latin-1 characters, one character a byte). A token
may follow another only if merging would leave the two apart; that is decided from the merge that made each
of them and remembered by pair. If no entry fits, the last token is taken back and its next shorter
prefix tried; a position from which no way led on is never tried again, so the work is linear in the
piece. The result is the one that merging by rank gives, because a sequence of tokens is that result
exactly if every adjacent pair is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Batches, texts

#: Entries that a worker's memory of stretches (and of pairs) holds before it starts anew. Results do not depend on it.
REMEMBERED = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes, a space and the rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Merges:
    """A vocabulary with what backtracking needs: each token's merge, its next shorter prefix, and which pairs stay apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        self.length = [0] * size
        self.prefix = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        for token, rank in ranks.items():
            self.token[rank], self.length[rank] = token, len(token)
            self.prefix[rank] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1)
        for rank in sorted(ranks.values()):  # a token's merge joins two earlier ones that merging leaves adjacent
            token = self.token[rank]
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k], size), ranks.get(token[k:], size)
                if left < rank and right < rank and self.stays_apart(left, right):
                    self.parts[rank] = left, right
                    self.merged[left, right] = rank
                    break
        self.apart.clear()

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens together gives just these two.

        Undo the later of the two merges again and again; if at any step the tokens that then meet at the seam
        have a merge that would have come before the one undone, it would have happened.
        """
        limit = len(self.token)
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            a, b = self.parts[left], self.parts[right]
            if b is None and a is None:
                return True
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * (n + 1)
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - self.length[rank]] = rank  # matches come by rising end
        length, prefix, apart = self.length, self.prefix, self.apart
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                if not dead[at + length[token]]:
                    if not out:
                        break
                    pair = out[-1], token
                    fits = apart.get(pair)
                    if fits is None:
                        if len(apart) >= REMEMBERED:
                            apart.clear()
                        fits = apart[pair] = self.stays_apart(*pair)
                    if fits:
                        break
                token = prefix[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at]
            else:
                if not out:
                    raise ValueError("bytes that the vocabulary has no token for")
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                token = prefix[last]
        return out


class Pieces(dict):
    """Ids (32-bit little-endian bytes) of stretches of text, computed when first asked for.

    When the memory is full it becomes the older one, from which what is asked for again is taken over.
    """

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.find, self.older = merges, regex.compile(pattern).findall, {}

    def __missing__(self, stretch: str) -> bytes:
        got = self.older.get(stretch)
        if got is None:
            encode = self.merges.encode
            if stretch.isascii() and stretch[:1] == " " and stretch[1:].isalpha():  # one match of the pattern
                out = encode(stretch.encode())
            else:
                out = [i for word in self.find(stretch) for i in encode(word.encode())]
            got = np.array(out, "<i4").tobytes()
        if len(stretch) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[stretch] = got
        return got


def stretches(text: str) -> list[str]:
    """``text`` cut where no match of the pattern can cross: before a single space between two other characters.

    There the pattern starts anew: a match holds a space only at its start or inside a run of white space.
    Stretches that would begin or end inside such a run stay together.
    """
    parts = text.split(" ")
    out = [parts[0]]
    for part in parts[1:]:
        last = out[-1]
        if part and last and not part[0].isspace() and not last[-1].isspace():
            out.append(" " + part)
        else:
            out[-1] = last + " " + part
    return out


_loaded: dict[tuple[str, str], Pieces] = {}


def _pieces(path: str, pattern: str) -> Pieces:
    """One per Python worker and vocabulary."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Pieces(Merges(read_ranks(path)), pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text, each match of ``pattern`` encoded by itself.

    ``ranks_path`` is a rank file that every executor can open, as installed tokenizer packages are. Null and
    empty texts have no ids. Rows are independent, so repeated rows and ids give repeated results.
    """

    def run(batches: Batches) -> Batches:
        pieces = _pieces(ranks_path, pattern)
        look = pieces.__getitem__
        for batch in batches:
            for part in _slices(batch):
                ids = [b"".join(map(look, stretches(text))) if text else b"" for text in part.column("text").to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(ends), values)})

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def _slices(batch: pa.RecordBatch, rows: int = 1000) -> Batches:
    """A batch a thousand rows at a time, to bound what is held besides it."""
    return (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def _id_lists(column: pa.Array) -> Iterator[list[int]]:
    """The ids of each row; null ids are none."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for begin, end, null in zip(offsets[:-1].tolist(), offsets[1:].tolist(), column.is_null().to_pylist(), strict=True):
        yield [] if null else values[begin:end].tolist()


def _tokens(ranks_path: str) -> list[bytes]:
    ranks = read_ranks(ranks_path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, decoded: the bytes of the ids in order. Null ids are none."""

    def run(batches: Batches) -> Batches:
        token = _tokens(ranks_path).__getitem__
        for batch in batches:
            for part in _slices(batch):
                out = [b"".join(map(token, ids)) for ids in _id_lists(part.column("ids"))]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "decoded": pa.array(out, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of what they decode to)."""

    def run(batches: Batches) -> Batches:
        tokens = _tokens(ranks_path)
        token, decimal = tokens.__getitem__, [b"%d" % i for i in range(len(tokens))].__getitem__
        for batch in batches:
            for part in _slices(batch):
                n, shas, back = [], [], []
                for ids in _id_lists(part.column("ids")):
                    n.append(len(ids))
                    shas.append(hashlib.sha256(b",".join(map(decimal, ids))).hexdigest())
                    back.append(hashlib.sha256(b"".join(map(token, ids))).hexdigest())
                columns = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
                yield pa.record_batch({"doc_id": part.column("doc_id"), **columns})

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
