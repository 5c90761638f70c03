from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import slots
from millrace.llm.arrays import hashes, steps, texts, words

TEXT = st.one_of(st.none(), st.text(alphabet="aA bé\n\t🎉\x0b ", max_size=30))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=12))
def test_words_and_hashes(rows):
    buf, off = texts(pa.array(rows, pa.string()))
    starts, ends, row = words(buf, off)
    got = [(int(r), bytes(buf[a:b]).decode()) for a, b, r in zip(starts, ends, row, strict=True)]
    assert got == [(i, w) for i, t in enumerate(rows) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    value = hashes(buf, starts, ends)
    seen = {}
    for (_, w), h in zip(got, value.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.integers(0, 50), min_size=1, max_size=20), st.integers(1, 60))
def test_steps_cover_all_rows(lengths, most):
    off = np.concatenate([[0], np.cumsum(lengths)])
    parts = list(steps(off, most))
    assert [i for a, b in parts for i in range(a, b)] == list(range(len(lengths)))
    assert all(off[b] - off[a] <= most or b == a + 1 for a, b in parts)


@pytest.mark.parametrize("n", [0, 1000])
def test_bitmap_has_every_key(spark, n):
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63 - 1, n)
    words_ = slots.bitmap(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k")
    assert slots.among(words_, keys).all()
    assert slots.among(words_, rng.integers(-(2**63), 2**63 - 1, 5000)).mean() < 0.01
