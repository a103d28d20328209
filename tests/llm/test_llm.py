"""The corpus operators against plain versions on small inputs, and on the smallest given tables."""

import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenlake.llm import ann, bpe, chat, exact_dedup, licenses, packing, secrets, sharding, simhash, toxicity
from lumenlake.llm.components import components
from lumenlake.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, row string, shard int, key string, score double, base string, spans string, id string"
LONG = " ".join(f"w{n % 977}" for n in range(30_000))
ODD = [
    (1, "Hello world, this is a text."), (2, None), (3, ""), (4, " \t\n"), (5, "Hello  world,\nthis is a text."), (5, "Hello  world,\nthis is a text."), (None, "no id"), (None, None),
    (6, LONG), (7, LONG), (8, "x" * 30_000), (9, "naïve \U0001f600 日本語 ½ ²"), (10, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'), (11, "Released under the MIT License."), (12, "one two"),
]
PATTERN, RANKS, BYTE_BPE = public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "r", 1, "k", 0.5, "b", "s", "i") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints):
    """id -> smallest id reachable over fingerprints at most two bits apart; ids are distinct."""
    ids = sorted(prints)
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


# 1 ---------------------------------------------------------------------------------------------------------------


def test_op1_small(spark, odd, none):
    found = rows(simhash.near_duplicates(odd))
    assert [(i, f) for i, f, _ in found] == [(i, f) for i, f in sorted(((i, f"{fingerprint(t):016x}") for i, t in ODD), key=repr)]
    by_id = {i: c for i, _, c in found if i}
    assert (by_id[2], by_id[3], by_id[4], by_id[5], by_id[7]) == (2, 2, 2, 1, 6)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len({f for _, f, _ in found})
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == sorted({c for i, _, c in found if c})


@pytest.mark.parametrize("paired", [1, 32])
def test_op1_links_lose_none(spark, paired):
    random = np.random.default_rng(5)
    prints = {}
    for _ in range(12):  # clusters in which each is a bit or two from another
        x = int(random.integers(0, 2**63))
        for _ in range(10):
            x ^= sum(1 << int(b) for b in random.integers(0, 64, random.integers(1, 4)))
            prints[x] = len(prints)
    prints = {i: x for x, i in prints.items()}
    df = spark.createDataFrame([(i, simhash._signed(x)) for i, x in prints.items()], "id long, fingerprint long")
    found = {r["vertex"]: r["component"] for r in components(simhash.links(df, paired)).collect()}
    assert {i: found.get(i, i) for i in prints} == grouped(prints)


def test_pivots_bound_the_distance(spark):
    random = np.random.default_rng(1).integers(-(2**63), 2**63, 200)
    df = simhash.pivot_table(spark.createDataFrame([(int(x),) for x in random], "fingerprint long"))
    for r in df.collect():
        x = r["fingerprint"] & (2**64 - 1)
        assert [r["spread"] >> 8 * k & 255 for k in range(8)] == [(x ^ p).bit_count() for p in simhash.SPREAD_REFERENCES]


# 2 ---------------------------------------------------------------------------------------------------------------


def check_packing(found, texts):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.encode_special_tokens = True
    wanted = []
    for i, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or min(len(ids), 2048)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        wanted += [(i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted([tuple(r)[:5] for r in found], key=repr) == sorted(wanted, key=repr)
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places), sum(r["length"] for r in found)


def test_op2_small(odd, none):
    check_packing(packing.pack(odd, BYTE_BPE).collect(), ODD)
    assert packing.pack(none, BYTE_BPE).count() == 0
    assert packing.pack(odd, BYTE_BPE, with_ids=True).filter(F.size("ids") != F.col("length")).count() == 0


def test_op2_table(spark, sf_dir, docs):
    sequences, tokens = check_packing(QUERIES["op2_best_fit_packing"](spark, sf_dir).collect(), docs)
    assert sequences <= 1.05 * tokens / 2048 + 1


def test_merging_in_bounded_tasks(spark):
    sizes = np.random.default_rng(0).integers(1, 2040, 500)
    bins = spark.createDataFrame([(n, int(s), n % 7) for n, s in enumerate(sizes)], "bin long, fill long, part long")
    for in_task in (10**6, 60):
        found = packing.merge_underfull(bins, in_task=in_task, fan=2).collect()
        assert sorted(r["bin"] for r in found) == [*range(500)]
        ends = {}
        for r in sorted(found, key=lambda r: r["base"]):
            assert r["base"] == ends.get(r["sequence_id"], 0)
            ends[r["sequence_id"]] = r["base"] + int(sizes[r["bin"]])
        assert max(ends.values()) <= 2048 and len(ends) < 500


# 3 ---------------------------------------------------------------------------------------------------------------


def test_op3_small(odd, none, encoding):
    encoded = bpe.encode(odd, RANKS, PATTERN)
    assert rows(encoded) == sorted(((i, encoding.encode_ordinary(t or "")) for i, t in ODD), key=repr)
    assert sorted((bytes(r["decoded"]) for r in bpe.decode(encoded, RANKS).collect())) == sorted((t or "").encode() for _, t in ODD)
    assert bpe.digests(bpe.encode(none, RANKS, PATTERN), RANKS).count() == 0


def test_op3_table(spark, sf_dir, docs, encoding):
    wanted = []
    for i, text in docs:
        ids = encoding.encode_ordinary(text)
        wanted.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert rows(QUERIES["op3_byte_bpe"](spark, sf_dir)) == sorted(wanted, key=repr)


@pytest.fixture(scope="module")
def pieces():
    return bpe.Pieces(bpe.Merges(bpe.read_ranks(RANKS)), PATTERN)


@settings(max_examples=500, deadline=None)
@given(text=st.text(st.sampled_from("abehinot  '\n\t.,!éñß中日123A\u0085 \u001c²½\U0001f600"), max_size=40) | st.text(max_size=20))
def test_op3_any_text(pieces, encoding, text):
    text = text.encode("utf-8", "ignore").decode()
    got = np.frombuffer(b"".join(pieces[s] for s in bpe.stretches(text)), "<i4").tolist()
    assert got == encoding.encode_ordinary(text)


# 4 ---------------------------------------------------------------------------------------------------------------


def test_op4(spark, odd, none, sf_dir, docs):
    found = {r["doc_id"]: r["licenses"] for r in licenses.findings(odd).collect() if r["doc_id"]}
    assert found[11] == "mit" and set(found.values()) == {"", "mit"}
    assert licenses.findings(none).count() == 0
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "All rights reserved.": "all-rights-reserved", "GNU General Public License, version 3.": "gpl-3.0", "Released under the MIT License.": "mit", "Apache License, Version 2.0.": "apache-2.0"}
    got = {r["doc_id"]: set(filter(None, r["licenses"].split(","))) for r in QUERIES["op4_licenses"](spark, sf_dir).collect()}
    assert got == {i: {name for line, name in lines.items() if line in t} for i, t in docs}


# 5 ---------------------------------------------------------------------------------------------------------------


def test_op5(spark, sf_dir, odd, none):
    labels = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    table = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    model = toxicity.train(table, labels)
    scored = toxicity.score(table, model).join(labels, "doc_id").filter(toxicity.held_out()).select("score", "toxic").toPandas()
    assert ((scored.score >= 0.5) == (scored.toxic > 0)).mean() > 0.9
    small = toxicity.score(odd, model).collect()
    assert len(small) == len(ODD) and all(0 <= r["score"] <= 1 for r in small)
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).filter("score is null").count() == 0
    channel = toxicity.Channel(model.counts)
    for disguised, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("l0s3r", "loser"), ("iiiidiooot", "idiot"), ("s.t.u.p.i.d", "stupid")):
        assert channel.restore(disguised) == word


# 6 ---------------------------------------------------------------------------------------------------------------


def chat_wanted(turns):
    out = []
    for i in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == i), key=lambda t: ((t[1] is not None, t[1] or 0), (t[2] is not None, t[2] or ""), (t[3] is not None, t[3] or "")))
        said = "".join(t[3] or "" for t in own if t[2] == "assistant")
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        out.append((i, len(own), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_op6(spark, sf_dir, monkeypatch):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST] <|end|>\n<|turn|>user\n"), (1, 2, "assistant", None), (2, None, None, "é\U0001f600"), (2, 0, "a\\b\n<|turn|>", ""),
        (None, 0, "user", "x"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "user", LONG),
    ]
    turns += [(5, n, "assistant" if n % 2 else "user", f"t{n}") for n in range(5000)]  # more than a row's turns
    schema = "conv_id long, turn long, role string, text string"
    read = lambda df: rows(chat.read_back(chat.format_chats(df)).drop("formatted_chars"))
    assert read(spark.createDataFrame(turns, schema).withColumn("piece", F.lit("clash"))) == chat_wanted(turns)
    assert read(spark.createDataFrame([], schema)) == []
    given = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf_dir}/conversations.parquet'").fetchall()
    extra = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert rows(QUERIES["op6_chat_format"](spark, sf_dir).drop("formatted_chars")) == chat_wanted([*given, *extra])


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("<[\\|>/s]\n") | st.sampled_from("aéINSTYturend"), max_size=30) | st.lists(st.sampled_from(["<", "[", "\\", "|turn|>", "/s>", "INST]", "<SYS>>", "|end|>"]), max_size=9).map("".join))
def test_op6_escape(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in ("<|turn|>", "<|end|>", "</s>", "[INST]"))


# 7 ---------------------------------------------------------------------------------------------------------------


def test_op7(spark, sf_dir):
    random = np.random.default_rng(3)
    base = random.normal(size=(400, 16))
    base[100:160] = base[0]  # many equal vectors
    rows_ = [(n, [float(x) for x in v], "c") for n, v in enumerate(base)]
    bad = [(1000, None, "c"), (1001, [0.0] * 16, "c"), (1002, [None, *[1.0] * 15], "c"), (1003, [float("nan"), *[1.0] * 15], "c"), (1004, [float("inf"), *[1.0] * 15], "c"), (1005, [1.0] * 3, "c"), (None, [1.0] * 16, "c")]
    schema = "vec_id long, embedding array<double>, class string"
    df = spark.createDataFrame([*rows_, *bad, rows_[3]], schema)
    found = ann.nearest(df, F.col("vec_id") % 20 == 0, 20).toPandas()
    recall = []
    for q in range(0, 400, 20):
        scores = (base * base[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(400), -scores)) if i != q][:20]
        own = found[found.query_id == q].sort_values("rank")
        assert list(own["rank"]) == [*range(1, 21)] and np.allclose(own.score, scores[own.vec_id], atol=1e-12) and list(own.score) == sorted(own.score, reverse=True)
        recall.append(len({*order} & {*own.vec_id}) / 20)
    assert np.mean(recall) >= 0.9 and not {*bad_ids(found)} & {1000, 1001, 1002, 1003, 1004, 1005}
    assert found[found.query_id == 0].sort_values("rank").vec_id.tolist() == [*range(100, 120)]  # ties to the smaller id
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(spark.createDataFrame(rows_[:3], schema), F.col("vec_id") == 0).count() == 2
    exact = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.array([v for _, v in exact])
    got = QUERIES["op7_nearest"](spark, sf_dir).toPandas()
    hits = [len({*np.argsort(-np.where(np.arange(len(x)) == q, -9, x @ x[q]))[:20]} & {*got[got.query_id == q].vec_id}) / 20 for q in range(0, len(x), 20)]
    assert np.mean(hits) >= 0.9


def bad_ids(found):
    return pd.concat([found.vec_id, found.query_id]).tolist()


# 8 ---------------------------------------------------------------------------------------------------------------


def base_spans(text):
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def entropy(text, width=20):
    width = min(width, len(text))
    windows = [text[k : k + width] for k in range(len(text) - width + 1)]
    return max(-sum(w.count(c) / width * np.log2(w.count(c) / width) for c in set(w)) for w in windows)


def test_op8(spark, sf_dir, odd, none, docs):
    random = np.random.default_rng(4)
    parts = ["token", "SECRET", "Api_Key", "=", " ", ":", '"', "é", "\U0001f600", "AKIA", "ABCDEFGHIJKL1", "0123456789abcdef", "deadbeef01", "x", "password", ".", "\n", "zz9Zq8Kx7Wm3Vb2N"]
    made = [(n, "".join(random.choice(parts, random.integers(0, 14)))) for n in range(800)]
    for source, texts in ((odd, ODD), (spark.createDataFrame(made, "doc_id long, text string"), made), (spark.read.parquet(f"{sf_dir}/documents.parquet"), docs)):
        got = rows(secrets.findings(source).select("doc_id", "base_sha256"))
        assert got == sorted(((i, hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for i, t in texts), key=repr)
    assert secrets.findings(none).count() == 0
    words = ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "abcabcabc", "a", "0" * 40]
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", secrets.largest_entropy(F.col("w"), "entropy_hex").alias("h")).collect():
        assert r["h"] == pytest.approx(entropy(r["w"]), abs=1e-9)
    texts = [(1, "key 9Zq8Kx7Wm3Vb2NpL0tRy5 end"), (2, "id 123e4567-e89b-12d3-a456-426614174000 end"), (3, "EXAMPLE9Zq8Kx7Wm3Vb2NpL0"), (4, "aaaaaaaaaaaaaaaaaaaaaaaa1")]
    got = {r["doc_id"]: r["spans"] for r in secrets.findings(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: "entropy_mixed:4:25", 2: "", 3: "", 4: ""}


def test_op8_redact(spark, odd):
    kept = {r["doc_id"]: r["text"] for r in secrets.redact(odd).collect() if r["doc_id"]}
    assert kept[10] == 'token'.replace("token", "[assign]") + '" end' and all(kept[i] == t for i, t in ODD if i and i != 10)
    assert secrets.redact(odd).columns == odd.columns
    assert {(r["base"], r["spans"], r["row"]) for r in secrets.redact(odd).collect()} == {("b", "s", "r")}  # columns of these names stay
    assert {(r["base"], r["row"]) for r in exact_dedup.drop_exact_duplicates(odd).collect()} == {("b", "r")}


# 9 ---------------------------------------------------------------------------------------------------------------


def test_op9(spark, sf_dir, odd, none):
    found = exact_dedup.exact_duplicates(odd).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert (by_id[5]["keep_id"], by_id[5]["group_size"], by_id[7]["keep_id"], by_id[3]["keep_id"], by_id[4]["group_size"]) == (1, 3, 6, 2, 1)
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(r["text_sha256"] for r in found) == sorted(hashlib.sha256(normal(t).encode()).hexdigest() for _, t in ODD)
    assert sum(r["kept"] for r in found) == len({normal(t) for _, t in ODD}) == exact_dedup.drop_exact_duplicates(odd).count()
    weak = {"one byte": lambda x: x[:1], "strong": exact_dedup.DIGESTS["sha256"]}  # shared identifiers are found out
    assert rows(exact_dedup.exact_duplicates(odd, weak)) == rows(exact_dedup.exact_duplicates(odd))
    with pytest.raises(ValueError, match="identifier"):
        exact_dedup.exact_duplicates(odd, {"one byte": lambda x: x[:1]})
    assert exact_dedup.exact_duplicates(none).count() == 0
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    wanted = con.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({ORACLES['op9_exact_dedup']})").fetchall()
    assert rows(QUERIES["op9_exact_dedup"](spark, sf_dir)) == sorted(wanted, key=repr)


def test_repeated_row_keeps_one(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a  b"), (1, "a b")], "doc_id long, text string")
    assert [r["kept"] for r in exact_dedup.exact_duplicates(df).collect()].count(True) == 1


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200).map(lambda b: b * 300), st.integers(0, 5000))
def test_chunks_cover(text, cut):
    assert b"".join(exact_dedup.chunks(text)) == text
    assert exact_dedup.normalise(text[:cut]) == re.sub(rb"[\x20\x09-\x0d]+", b" ", text[:cut])
    assert all(len(c) <= exact_dedup.MOST for c in exact_dedup.chunks(text))


# 10 --------------------------------------------------------------------------------------------------------------


def check_shards(found, texts, shards):
    size = lambda t: len((t or "").encode()) + 16
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=repr) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t in texts), key=repr)
    mean, most = sum(r["size"] for r in found) / shards, max((r["size"] for r in found), default=0)
    for s in range(shards):
        own = [r for r in found if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == [*range(len(own))]
        assert abs(sum(r["size"] for r in own) - mean) <= most
    order = [r["doc_id"] for r in sorted(found, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] is not None]
    assert order == sorted(order)


def test_op10(spark, sf_dir, odd, none, docs):
    check_shards(sharding.byte_shards(odd, 3).collect(), ODD, 3)
    check_shards(QUERIES["op10_sharding"](spark, sf_dir).collect(), docs, 40)
    assert sharding.byte_shards(none, 4).count() == 0


# All -------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = table
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir)
        if name != "packing":
            assert docs.columns == table.columns
            assert docs.count() <= before.count()
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    check_packing(docs.collect(), [(i, t) for i, t in texts.items()])
    assert not any(base_spans(t) for t in texts.values())
    assert len({" ".join(t.split()) for t in texts.values()}) == len(texts)
    assert {fingerprint(t) for t in texts.values()}


def test_nothing_else_imports_this():
    root = Path(licenses.__file__).parent.parent
    for file in root.rglob("*.py"):
        if "llm" not in file.parts:
            assert "llm" not in file.read_text()
