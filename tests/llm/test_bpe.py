"""Exact encoding: against the public library, the merge loop, and a round trip."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.worker_encoder(f.read())


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def ids(encoder, text):
    return np.frombuffer(encoder.encode_packed(text), dtype=np.int32).tolist()


CASES = ["", " ", "a", "don't we'll I'D", "<|endoftext|>", "سلام دنیا‌ی ۱۲۳", "  \t\n\r\n x  ", "²½Ⅷ٣①x", "é‌‏�🏠🏠", "_a_b__ 'll", "a" * 3000, "ab" * 2000, "سلام" * 500, "x　 y   "]


@pytest.mark.parametrize("text", CASES)
def test_like_the_library(encoder, reference, text):
    assert ids(encoder, text) == reference.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(encoder, reference, text):
    got = ids(encoder, text)
    assert got == reference.encode_ordinary(text)
    assert b"".join(encoder.bytes_of[i] for i in got).decode() == text


@settings(max_examples=100, deadline=None)
@given(st.text("abcdeـسلا", min_size=1, max_size=30))
def test_words_like_the_merge_loop(encoder, word):
    assert encoder.encode_word(word) == encoder.merge(word.encode())


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b", 0), (2, None, 0), (3, "", 0), (1, "a b", 1)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, tuple(r.ids)) for r in bpe.encode(df).collect())
    assert got == [(1, (64, 275)), (1, (64, 275)), (2, ()), (3, ())]
    assert sorted((r.doc_id, r.tokens) for r in bpe.count_tokens(df).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert bpe.encode(df.limit(0)).count() == 0
