from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import repeated_bytes
from millrace.llm.repeated_bytes import LEAST, LENGTH, without_repeats


def gone(raws, length):
    """Which bytes of each text a string of ``length`` bytes covers that starts elsewhere too."""
    where = defaultdict(int)
    for raw in raws:
        for i in range(len(raw) - length + 1):
            where[raw[i : i + length]] += 1
    out = []
    for raw in raws:
        marks = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if where[raw[i : i + length]] > 1:
                marks[i : i + length] = b"\1" * length
        out.append(marks)
    return out


def expected(rows):
    out = Counter()
    raws = [(t or "").encode() for _, t in rows]
    for (d, _), raw, far, near in zip(rows, raws, gone(raws, LENGTH), gone(raws, LEAST), strict=True):
        spans = sum(far[i] and (i == 0 or not far[i - 1]) for i in range(len(raw)))
        out[d, len(raw), sum(far), spans, sum(near), bytes(b for b, g in zip(raw, far, strict=True) if not g)] += 1
    return out


def fixture():
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passage, other = text(700), text(410)
    rows = [(i, text(int(rng.integers(0, 300))) + p + text(int(rng.integers(0, 300)))) for i, p in enumerate([passage, passage[:500], passage[100:], other, other, text(600), passage[:399], passage[5:405], passage + other])]
    long = text(1500)
    edited = long[:700] + "X" + long[701:]
    rows += [(20, long), (21, edited), (22, edited), (23, "a" * 2000), (24, "ab" * 300), (25, "a" * 400), (26, None), (27, ""), (28, "short"), (29, long[3:]), (30, "é" * 500)]
    rows += [(40 + i, text(50) + passage[int(rng.integers(0, 100)) : 600] + text(50)) for i in range(10)]
    rows += [(60 + i, text(40) + x + text(i)) for i, x in enumerate([text(30) + passage[50:274], passage[50:274], passage[60:283], other[-230:], other[-399:], other[-224:] + "\0" * 200, other[-224:] + "\0" * 200])]
    rows += [(80, text(100) + passage[:300]), (81, text(90) + passage[:300]), (82, passage[:300])]
    return [*rows, (23, "a" * 2000), (None, text(20) + other)]


@pytest.mark.parametrize("often", [2000, 1])
def test_equals_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(repeated_bytes, "OFTEN", often)
    rows = fixture()
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, core int").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.n_repeated, bytes(r.kept)) for r in without_repeats(docs).collect())
    assert got == expected(rows)


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
