"""Fill-in-middle against plain slices, over texts of any kind."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenlake.llm import fill_middle
from lumenlake.llm.queries import ORACLES, QUERIES


def plain(text, doc):
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


PIECES = st.lists(st.sampled_from(["a", "Zz", " ", "\n", "<", "P", ">", "S", "M", "<P", "<S>", "é", "日", "\U0001f600", "0", "@", "[", "`", "{", "\x85"]), max_size=40)


@settings(max_examples=400, deadline=None)
@given(PIECES.map("".join), st.integers(0, 10**6), st.sampled_from([1, 2, 3, 7, 1 << 20]))
def test_equals_slices_at_any_step(text, doc, step):
    before, fill_middle.STEP = fill_middle.STEP, step
    try:
        n, form, prefix, middle, output = fill_middle.transform(text.encode(), doc)
        assert (n, form, prefix, middle, output.decode()) == plain(text, doc)
        assert fill_middle.invert(bytes(output), form).decode() == text
    finally:
        fill_middle.STEP = before


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=50), st.data(), st.sampled_from([1, 3, 8, 64]))
def test_rotation_is_its_own_kind_of_inverse(data, draw, step):
    low, cut, high = sorted(draw.draw(st.lists(st.integers(0, len(data)), min_size=3, max_size=3)))
    before, fill_middle.STEP = fill_middle.STEP, step
    try:
        turned = bytearray(data)
        fill_middle.rotate(turned, low, cut, high)
        assert bytes(turned) == data[:low] + data[cut:high] + data[low:cut] + data[high:]
        fill_middle.rotate(turned, low, low + high - cut, high)
        assert bytes(turned) == data
    finally:
        fill_middle.STEP = before


def test_odd_rows(spark):
    long = " ".join(f"w{n % 977}é" for n in range(400_000))
    rows = [(1, None), (2, ""), (3, "x" * 3_000_000), (4, long), (5, "<P> there"), (5, "<P> there"), (None, "no id"), (None, None), (6, " \t\n"), (7, "naïve \U0001f600 日本語")]
    df = spark.createDataFrame([(d, t, "o", "f", 1) for d, t in rows], "doc_id long, text string, output string, form string, n int")
    out = fill_middle.restore(fill_middle.fill_in_middle(df)).collect()
    got = sorted(((r["doc_id"], (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]), r["restored"]) for r in out), key=repr)
    assert got == sorted(((d, plain(t or "", d), t or "") for d, t in rows), key=repr)
    assert fill_middle.digests(fill_middle.fill_in_middle(df.limit(0))).count() == 0


def test_large_outputs_leave_in_several_batches(spark, monkeypatch):
    made = [*fill_middle._batches(iter([(k, b"x" * 100) for k in range(10)]), {"k": fill_middle.pa.int64(), "t": fill_middle.pa.string()})]
    assert [b.num_rows for b in made] == [10]
    monkeypatch.setattr(fill_middle, "BATCH_BYTES", 250)
    made = [*fill_middle._batches(iter([(k, b"x" * 100) for k in range(10)]), {"k": fill_middle.pa.int64(), "t": fill_middle.pa.string()})]
    assert [b.num_rows for b in made] == [3, 3, 3, 1]


def test_tokens_across_steps(monkeypatch):
    text = "abc d日éf ghi".encode()
    whole = np.frombuffer(text, np.uint8)
    expected = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text.decode())]
    starts = [len(text.decode()[:k].encode()) for k in expected]
    for step in range(1, 12):
        monkeypatch.setattr(fill_middle, "STEP", step)
        counts = fill_middle.count_tokens(whole)
        assert [fill_middle.cut_at(whole, counts, k) for k in range(len(starts) + 1)] == [*starts, len(text)]


@pytest.mark.parametrize("name", ["op12_fill_in_middle"])
def test_query_equals_sql(spark, sf_dir, name):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()), key=key) == sorted(duckdb.sql(ORACLES[name]).fetchall(), key=key)
