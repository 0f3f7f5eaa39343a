"""Monoid BPE against the public library, and exact round trips."""

import random

import hashlib
import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from topictone.llm.bpe import MonoidBPE, bpe_documents, read_ranks
from topictone.llm.queries import op9_bpe_monoid

RANKS = read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
BPE = MonoidBPE(RANKS, public.PATTERN)
LIB = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return np.frombuffer(BPE.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert ids(text) == LIB.encode_ordinary(text)
    assert BPE.decode(BPE.encode(text)) == text.encode()


def test_random_pieces():
    rng = random.Random(7)
    parts = ["a", "b", "ab", "the", "é", "日本", "　", " ", "\n", "1", "22", "'s", "$$", "-", "😀", "\x1c", "\x85", "ſ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))
        assert ids(text) == LIB.encode_ordinary(text)


@pytest.mark.parametrize("unit", ["a", "ab", "the", "é", "日", "=-", " ", "x1"])
def test_long_single_pieces_use_the_tree(unit):
    text = unit * 5000
    assert ids(text) == LIB.encode_ordinary(text)


def test_join_equals_whole():
    rng = random.Random(3)
    for _ in range(500):
        data = bytes(rng.choice(b"abcdeth in\xc3\xa9") for _ in range(rng.randint(2, 90)))
        cut = rng.randint(1, len(data) - 1)
        assert BPE.join(BPE.merged(data[:cut]), BPE.merged(data[cut:])) == BPE.merged(data)


def test_nulls_empty_long_repeats_clashing_names(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (3, "wörd " * 50_000, "z"), (None, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe_documents(df, RANKS, public.PATTERN).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == 0 and by[1].ids == [] and by[1].decoded == ""
    assert by[3].ids == LIB.encode_ordinary("wörd " * 50_000) and by[3].decoded == "wörd " * 50_000
    assert by[None].ids == LIB.encode_ordinary("a b")
    assert bpe_documents(df.limit(0), RANKS, public.PATTERN).count() == 0


def test_query_against_library(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").collect()
    got = {r.doc_id: r for r in op9_bpe_monoid(spark, sf001).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want = LIB.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
