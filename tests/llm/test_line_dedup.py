from __future__ import annotations

import time
from collections import Counter

import numpy as np

from millrace.llm.line_dedup import CHARS_PER_EDIT, without_repeated_lines


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def expected(rows):
    seen, out = [], {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        lines, left = (t or "").split("\n"), []
        for x in lines:
            if not x.strip(" \t\n\x0b\x0c\r"):
                left.append(x)
                continue
            if not any(x == y or max(len(x), len(y)) >= CHARS_PER_EDIT and within_one(x, y) for y in seen):
                left.append(x)
            seen.append(x)
        out[d] = (len(lines), len(lines) - len(left), "\n".join(left))
    return out


def fixture():
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdé 🎉"), int(rng.integers(1, 60)))) for _ in range(60)]
    rows = []
    for d in rng.permutation(80):
        lines = []
        for _ in range(int(rng.integers(0, 8))):
            x = base[int(rng.integers(0, 60))]
            for _ in range(int(rng.integers(0, 3))):
                i, kind = int(rng.integers(0, len(x) + 1)), int(rng.integers(0, 3))
                x = x[:i] + ("" if kind == 0 else "z") + x[i + (kind != 1) :]
            lines.append(x)
        rows.append((int(d), "\n".join(lines)))
    return [*rows, (500, None), (501, "\n\n \n"), (502, "a" * 3000 + "\n" + "a" * 3001), (503, "aaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaa")]


def test_equals_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, place int").repartition(3)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in without_repeated_lines(docs).collect()} == expected(rows)


def test_lines_of_a_million_characters(spark):
    rng = np.random.default_rng(9)
    line = "".join(rng.choice(list("abcdefgh "), 1_000_000))
    rows = [(1, line), (2, line[:400_000] + "é" + line[400_001:]), (3, line[1:]), (4, line[:-5] + "12345"), (5, "é" * 1_000_000 + "\n" + "é" * 999_999)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    began = time.time()
    got = {r.doc_id: r.n_removed for r in without_repeated_lines(docs).select("doc_id", "n_removed").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1} and time.time() - began < 60


def test_edges(spark):
    docs = spark.createDataFrame([(None, "same line"), (3, "same line"), (3, "same line"), (3, "other"), (None, "lone")], "doc_id long, text string")
    assert without_repeated_lines(docs.limit(0)).collect() == []
    assert Counter((r.doc_id, r.kept) for r in without_repeated_lines(docs).collect()) == Counter({(None, ""): 1, (3, "same line"): 2, (3, "other"): 1, (None, "lone"): 1})
