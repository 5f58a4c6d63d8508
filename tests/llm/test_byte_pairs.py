import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from warpline.llm import byte_pairs as B

pytestmark = pytest.mark.skipif(not os.path.exists(B.VOCABULARY), reason="no vocabulary")
ODD = ["", " ", "a\x1cb", "\x1c\x1d", " \x1f x", "a\u0085b", "½ ⅷ ² x²", "‍👩", "_a_b__", "  \n\n x", "\n x \t", "é́̂", "한글12", "aaaaaaaaaaaa", "<|endoftext|>", "it's WE'VE don't", "　あ", "٣٤x", "﻿x", "a b ᠎ c", "\x00\x01", "१२", "ǅ", "''s 'll", "\r\n\r\n", "x" * 5000]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(B.VOCABULARY)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def merges():
    return B.Merges()


def test_odd_texts(reference, merges):
    got = B._encode_batch(ODD, merges).to_pylist()
    assert got == [reference.encode(t, add_special_tokens=False).ids for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    from tokenizers import Tokenizer

    if not hasattr(test_any_text, "held"):
        t = Tokenizer.from_file(B.VOCABULARY)
        t.encode_special_tokens = True
        test_any_text.held = t, B.Merges()
    t, m = test_any_text.held
    assert B._encode_batch(texts, m).to_pylist() == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_query(spark, monkeypatch):
    texts = [None, "", " ", "one two", "one two", "x y" * 1000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "q", "")], "doc_id bigint, text string, ids string")
    got = {r[0]: r[1] for r in B.token_ids(df).collect()}
    assert got[0] == got[1] == [] and got[3] == got[4] == [505, 734] and None in got and len(got) == 7
    monkeypatch.setattr(B, "CHARACTERS_AT_ONCE", 10)
    assert {r[0]: r[1] for r in B.token_ids(df).collect()} == got
    assert B.token_ids(df.limit(0)).count() == 0
