"""The pipeline ends in tokens, not in their digests alone, and tokens are those of the tokenizer file."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenlake.llm.packing import token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return made


def test_packing_stage_writes_tokens(spark, sf_dir, tokenizer):
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = {1: "Hello world, this is a text.", 2: "", 3: "a <|endoftext|> b"}
    found = pipeline.packing(spark, spark.createDataFrame([*texts.items()], "doc_id long, text string"), sf_dir).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == {i: [*tokenizer.encode(x, add_special_tokens=False).ids, 0] for i, x in texts.items()}
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in found)


def test_every_character(tokenizer):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}1{c} " for c in letters[k : k + 2000]) for k in range(0, len(letters), 2000)]
    for text, wanted in zip(texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert token_ids(text, PATH).tolist() == [*wanted.ids, 0]


@settings(max_examples=500, deadline=None)
@given(text=st.text(st.sampled_from("abehinot  '\n\t.,!éñß中日123A\u0085  ‍́ \u001c²½\U0001f600"), max_size=60) | st.text(max_size=20))
def test_any_text(tokenizer, text):
    text = text.encode("utf-8", "ignore").decode()
    assert token_ids(text, PATH).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("text", ["x" * 300_000, " " * 300_000 + "a", "\n" * 300_000, "^" * 300_000, "a" + " \n" * 150_000, "日" * 100_000])
def test_long_runs(tokenizer, text):
    assert token_ids(text, PATH).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
