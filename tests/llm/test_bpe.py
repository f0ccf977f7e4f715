"""The encoder against an independent implementation, and exact round trips."""

import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks()
    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Decoder(ranks)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(both, t):
    e, k, d = both
    ids = e.encode(t)
    assert ids == k.encode_ordinary(t) and d.decode(ids) == t


def test_hard_pieces(both):
    e, k, _ = both
    rnd = random.Random(3)
    for alphabet in ("a", "ab", "abc", "aeinrst", "  \n", "=-_", "é日本"):
        for n in (1, 2, 7, 50, 3000):
            t = "".join(rnd.choice(alphabet) for _ in range(n))
            assert e.encode(t) == k.encode_ordinary(t)
    t = "a" * 300_000
    assert e.encode(t) == k.encode_ordinary(t)
    assert e.encode("<|endoftext|>") == k.encode_ordinary("<|endoftext|>")


def test_table(spark, both):
    e, _, _ = both
    df = spark.createDataFrame([(1, "Two words", [9]), (2, None, [9]), (3, "", [9]), (4, " ", None), (1, "Two words", [9])], "doc_id long, text string, ids array<int>")
    got = sorted((r.doc_id, tuple(r.ids)) for r in bpe.encode(df, "doc_id", "text").collect())
    two = tuple(e.encode("Two words"))
    assert got == [(1, two), (1, two), (2, ()), (3, ()), (4, tuple(e.encode(" ")))]
    back = bpe.decode(bpe.encode(df, "doc_id", "text"), "doc_id")
    assert sorted(r.text for r in back.collect()) == ["", "", " ", "Two words", "Two words"]
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def test_other_vocabulary(both):
    ranks = bpe.read_ranks("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    e = bpe.Encoder(ranks)
    k = tiktoken.Encoding("multi", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in ("Le nodule du lobe inférieur", "结节 5.9 mm", "По данным д-ра", "x" * 500):
        assert e.encode(t) == k.encode_ordinary(t)
