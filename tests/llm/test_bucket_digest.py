from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from millrace.llm import bucket_digest
from millrace.llm.bucket_digest import _ranges, digests, fingerprints, likeness


def digest(raw):
    """Length code, ratios and quartile codes of a text, one window of 5 bytes at a time."""
    counts = [0] * 128
    for i in range(len(raw) - 4):
        w = raw[i : i + 5]
        for salt, (a, b, c) in enumerate([(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4)]):
            x = ((w[a] | w[b] << 8 | w[c] << 16) * 0x9E3779B1 + salt * 0x85EBCA6B) % 2**32
            x = (x ^ x >> 15) * 0x2C1B3C6D % 2**32
            counts[x >> 25] += 1
    q1, q2, q3 = (sorted(counts)[k] for k in (31, 63, 95))
    return [min(255, round(8 * math.log2(len(raw) + 1))), q1 * 15 // max(q3, 1), q2 * 15 // max(q3, 1)], [(n > q1) + (n > q2) + (n > q3) for n in counts]


def name(d):
    (length, r1, r2), codes = d
    return f"{length:02x}{r1:x}{r2:x}" + "".join(f"{codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3]:02x}" for i in range(0, 128, 4))


def near(a, b):
    far = sum(abs(x - y) + 3 * (abs(x - y) == 3) for x, y in zip(a[1], b[1], strict=True))
    for x, y, weight in zip(a[0], b[0], (1, 4, 4), strict=True):
        gap = abs(x - y)
        far += min(30, gap if gap <= 1 else (gap - 1) * weight)
    return 1 - min(300, far) / 300


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = Counter()
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        a, e, x = (digest(s.encode()) for s in (t, edited, nxt))
        out[d, len(t), hashlib.sha256(edited.encode()).hexdigest(), name(a), name(e), near(a, e), near(a, x)] += 1
    return out


@pytest.mark.parametrize("range_rows", [4000, 7])
def test_rows(spark, monkeypatch, range_rows):
    monkeypatch.setattr(bucket_digest, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(2)
    rows = [(int(d), "".join(rng.choice(list("abc éü🎉\n"), int(rng.integers(0, 300))))) for d in rng.permutation(200)] + [(1000, None), (1001, ""), (-5, "x" * 50000)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, range int").repartition(3)
    assert Counter(map(tuple, fingerprints(docs).collect())) == expected(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "only")], "doc_id long, text string")
    assert fingerprints(docs.limit(0)).collect() == []
    assert [(r.doc_id, r.near_next) for r in fingerprints(docs).collect()] == [(1, 1.0)]
    ties = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, None)], "doc_id long, text string")
    assert Counter(r.doc_id for r in fingerprints(ties).collect()) == Counter({1: 2, None: 2})


def test_one_doc_id_and_null_may_hold_most_rows(spark, monkeypatch):
    monkeypatch.setattr(bucket_digest, "RANGE_ROWS", 20)
    texts = [f"text {i} {'z' * (i % 37)}" for i in range(300)]
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else 100 + i, t) for i, t in enumerate(texts)]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    # One ring over all rows: each text is once the next of another.
    prints = Counter(r.fingerprint for r in got)
    assert prints == Counter(name(digest(t.encode())) for t in texts)
    ordered = sorted((r for r in rows if r[0] is not None and r[0] >= 100), key=lambda r: -r[0])
    by_id = {r.doc_id: r for r in got}
    for (d, t), (_, nxt) in zip(ordered, ordered[1:], strict=False):
        h = len(t) // 2
        assert by_id[d].edited_sha256 == hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()


def test_ranges_follow_the_order_and_split_hot_ids():
    cuts, table = _ranges([5] * 500 + [None] * 300 + list(range(10, 210)), 10)
    assert 5.0 in cuts and 6.0 in cuts and cuts == sorted(set(cuts))
    by_bucket = {b: (at, n) for b, at, n in table}
    assert by_bucket[cuts.index(5.0) + 1][1] >= 4 and by_bucket[-1][1] == 3
    spans = sorted(by_bucket.values())
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert _ranges([2**62] * 10, 5)[0] == [float(2**62)]


def test_likeness_orders_edits():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    a = [word() for _ in range(400)]
    few = a[:380] + [word() for _ in range(20)]
    other = [word() for _ in range(400)]
    d = digests([" ".join(x).encode() for x in (a, few, other)])
    assert 1.0 == likeness(d[:1], d[:1])[0] > likeness(d[:1], d[1:2])[0] > likeness(d[:1], d[2:])[0] >= 0
