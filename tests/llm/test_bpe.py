from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.llm import bpe

TOKENIZERS = "/opt/tokenizers"


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(Path(f"{TOKENIZERS}/byte_bpe_50k.tiktoken").read_bytes())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_awkward_texts(encoder, reference):
    for t in ["", " ", "\n\n  x", "<|endoftext|>", "a" * 20_000, " " * 3000 + "x", "漢" * 3000, "naïve café 🚚📦 don't I'LL", "\u200b\ufeff\x00\x01", "ab" * 5000, "e\u0301" * 100]:
        assert encoder.encode(t) == reference(t)
    assert encoder.encode(None) == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_same_as_the_public_tokenizer(encoder, reference, text):
    assert encoder.encode(text) == reference(text)


def test_pieces_are_forgotten_not_confused(encoder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    t = "one two three four five six seven one two"
    assert encoder.encode(t) == reference(t)


def test_table(spark, reference):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "x")], "doc_id long, text string, _text string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_table(df, "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken").collect())
    assert got == [(1, reference("hello world"))] * 2 + [(2, []), (3, [])]
    assert bpe.encode_table(df.limit(0), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken").count() == 0
