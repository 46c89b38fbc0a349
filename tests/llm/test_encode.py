import os

import pytest
from hypothesis import given, settings, strategies as st

from mentia.llm.encode import TOKENIZERS, count_tokens, encode_corpus, encoder

tokenizers = pytest.importorskip("tokenizers")
PATH = f"{TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


def public():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_like_the_public_library(text):
    assert encoder(f"{TOKENIZERS}/byte_bpe_50k.tiktoken").encode(text) == public().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "a" * 20_000, "ab" * 9_000, " \n\t  x ", "<|endoftext|>", "việt 👍🏽 ﷺ", "we're it's 'LL", "0" * 3000])
def test_hard_texts(text):
    assert encoder(f"{TOKENIZERS}/byte_bpe_50k.tiktoken").encode(text) == public().encode(text, add_special_tokens=False).ids


def test_corpus(spark):
    df = spark.createDataFrame([(1, "Hello world", 9), (2, None, 9), (3, "", 9), (1, "Hello world", 9)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_corpus(df).collect())
    assert got == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert sorted(r.n_tokens for r in count_tokens(df, ["doc_id"]).collect()) == [0, 0, 2, 2]
    assert encode_corpus(df.limit(0)).count() == 0
