from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import near_dedup
from millrace.llm.components import components
from millrace.llm.superminhash import shingles, signatures


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sets(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows, k=3, percent=85):
    s = [sets(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, len(s[i]), low.get(find(i)), d is not None and d == low.get(find(i)) or d is None and low.get(find(i)) is None) for i, (d, _) in enumerate(rows))


def fixture():
    rng = np.random.default_rng(5)
    vocabulary = [f"W{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [vocabulary[i] for i in rng.integers(0, 400, int(rng.integers(2, 160)))]
        for _ in range(int(rng.integers(1, 25))):
            edited = list(base)
            for _ in range(int(rng.integers(0, 5))):
                edited[int(rng.integers(0, len(edited)))] = vocabulary[int(rng.integers(0, 400))]
            rows.append((len(rows) * 7 % 997 + 3, " ".join(edited) if g % 2 else "\n ".join(edited).lower()))
    rows += [(2000, ""), (2001, None), (2002, "one"), (2003, "ONE"), (2004, " \t\n"), (2005, "x " * 6000), (2006, "x x x"), (1, "lone é word here"), (2003, "ONE")]
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = fixture()
    docs = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, node string").repartition(3)
    assert Counter(map(tuple, near_dedup.near_duplicates(docs).collect())) == brute(rows)


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "other text of no one"), (9, None)], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs.limit(0)).collect() == []
    got = Counter(map(tuple, near_dedup.near_duplicates(docs).collect()))
    assert got == Counter([(None, 2, 4, False), (4, 2, 4, True), (None, 3, None, True), (9, 0, 9, True)])


def test_kept_rows(spark):
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(fixture())], "doc_id long, text string, root long")
    kept = near_dedup.keep_one_of_each(docs, 3, 85)
    want = {k[0] for k in brute(fixture()) if k[3]}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_signature_estimates_similarity():
    words = [f"q{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[500:2500])
    buf = np.frombuffer((a + b).encode(), np.uint8)
    row, value = shingles(buf, np.array([0, len(a), len(a) + len(b)]), 3)
    sig = signatures(row, value, 2, 256)
    assert abs((sig[0] == sig[1]).mean() - 1498 / 2498) < 0.12


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(0, 80, (60, 2))]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
