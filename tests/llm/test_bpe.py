import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skeinlab.llm import bpe

LIB = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
LIB.encode_special_tokens = True
HARD = ["", " ", "a", "  two  spaces ", "tabs\t\tand\r\n\r\nlines", "naïve café 中文字 😀👍🏽", "don't we'll I'm", "<|endoftext|>", "x" * 5000, "aaaaab" * 700, "12345 6,789.01", "​­﻿", "١٢٣ ½²", "\x00\x1c\x85 ", "🏳️‍🌈" * 50]


def lib(t):
    return LIB.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("text", HARD)
def test_equals_library(text):
    m = bpe.transducer()
    assert m.encode(text) == lib(text)
    assert m.decode(m.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equals_library_on_any_text(text):
    m = bpe.transducer()
    assert m.encode(text) == lib(text)
    assert m.decode(m.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 'seth1\n", max_size=80))
def test_equals_library_on_mergeable_text(text):
    assert bpe.transducer().encode(text) == lib(text)


def test_states_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "STATES_KEPT", 3)
    monkeypatch.setattr(bpe, "WORDS_KEPT", 2)
    m = bpe.transducer.__wrapped__()
    assert [m.encode(t) for t in HARD[3:8]] == [lib(t) for t in HARD[3:8]]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 7))
def test_streaming_utf8_equals_replacement_decoding(data, step):
    m = bpe.Utf8Machine()
    got = "".join(m.feed(data[i : i + step]) for i in range(0, len(data), step)) + m.end()
    assert got == data.decode("utf-8", "replace")


def test_documents_nulls_and_repeats(spark):
    d = spark.createDataFrame([(1, "hello world", 5), (2, "", 0), (3, None, None), (1, "hello world", 5)], "doc_id long, text string, ids int")
    rows = bpe.encode_documents(d).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in rows) == [(1, lib("hello world")), (1, lib("hello world")), (2, []), (3, [])]
    assert bpe.encode_documents(d.limit(0)).isEmpty()
