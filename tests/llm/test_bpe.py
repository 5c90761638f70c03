from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENS = bpe.read_ranks(PATH)
WHOLE = bpe.PerfectHash(TOKENS)
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})
TEXTS = ["", None, "Hello  world\n\n it's <|endoftext|> 123", "naïve ß 日本語 🎉🎉 \x1c\x1d   x", "a" * 3000, "Ouinör " * 900, "  \t \n", "\x00\x7f'll'LL"]


def test_perfect_hash_is_minimal_and_exact():
    assert sorted(WHOLE.slot_key) == list(range(len(TOKENS)))
    assert all(WHOLE.find(t) == i for i, t in enumerate(TOKENS))
    assert WHOLE.find(b"certainly not a token") is None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_known_library(text):
    ids = bpe.Encoder(TOKENS, WHOLE)
    import regex

    got = b"".join(ids[t] for t in regex.findall(public_tokenizers.PATTERN, text))
    assert np.frombuffer(got, "<u4").tolist() == KNOWN.encode_ordinary(text)


def test_rows(spark):
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(TEXTS * 2)] + [(None, "x y", b"")], "doc_id long, text string, ids binary")
    got = sorted(map(tuple, bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = KNOWN.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_memory_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3 * (bpe.ENTRY + 20))
    ids = bpe.Encoder(TOKENS, WHOLE)
    for word in ["the", "quick", "brown", "fox", "the", "jumps", "quixotry", "the", "zyzzyvas", "fox", "x" * 5000] * 3:
        assert np.frombuffer(ids[word], "<u4").tolist() == KNOWN.encode_ordinary(word)
        assert len(ids) <= 3 and len(ids.old) <= 3
        assert sum(bpe.ENTRY + len(k) + len(v) for k, v in ids.items()) <= bpe.REMEMBERED
