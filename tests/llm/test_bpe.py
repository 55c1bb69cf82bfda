import os

import pytest
from hypothesis import given, settings, strategies as hs
from pyspark.sql import functions as F

from lodestone.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER), reason="tokenizer file is not here")
SAMPLES = ["", " ", "\n\n  x", "don't 123abc", "哈哈哈 显示器，一旦 μs Ω", "<|endoftext|>", "a" * 500, "\t \t", "👩🏽‍🔧", "=" * 40, "abcabcab" * 20, "\u0000\u0001"]


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.TOKENIZER)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("text", SAMPLES)
def test_equals_the_public_library(public, text):
    assert bpe.encoder(bpe.TOKENIZER).encode(text) == public(text)


@settings(max_examples=300, deadline=None)
@given(hs.text(alphabet=hs.one_of(hs.characters(exclude_categories=["Cs"]), hs.sampled_from("aeinrst th 的一是0123=-")), max_size=60))
def test_any_text_equals_the_public_library_and_comes_back(public, text):
    e = bpe.encoder(bpe.TOKENIZER)
    ids = e.encode(text)
    assert ids == public(text) and e.decode(ids) == text


def test_table_and_dirt(spark):
    df = spark.createDataFrame([(1, "hello"), (1, "hello"), (2, None), (3, ""), (None, "x")], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("id", F.lit(1))
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect()), key=str)
    assert got == sorted([(1, [31373]), (1, [31373]), (2, []), (3, []), (None, [87])], key=str)
    back = sorted((str(r.doc_id), r.text) for r in bpe.decode_corpus(bpe.encode_corpus(df)).collect())
    assert back == sorted([("1", "hello"), ("1", "hello"), ("2", ""), ("3", ""), ("None", "x")])
    assert bpe.encode_corpus(df.limit(0)).count() == 0
