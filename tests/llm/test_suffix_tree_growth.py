from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from millrace.llm import suffix_tree
from millrace.llm.suffix_tree import scores

UNSEEN, PRIOR, LEAST, NEXT = 0.1, 20.0, 8, 2


def tree(sentences):
    """Contexts with their rest weight and next-word shares, grown by length as long as contexts diverge."""
    words = Counter(w for s in sentences for w in s[1:])
    n, v = sum(words.values()), len(words)
    root = {w: (c + UNSEEN) / (n + UNSEEN * (v + 1)) for w, c in words.items()}
    levels, shorter = [], {((), w): p for w, p in root.items()}
    while True:
        k = len(levels) + 1
        follow = {}
        for s in sentences:
            for i in range(max(1, k), len(s)):
                follow.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
        level = {}
        for c, nexts in follow.items():
            total = sum(nexts.values())
            if total < LEAST or k > 1 and c[1:] not in levels[-1]:
                continue
            listed = {w: m for w, m in nexts.items() if m >= NEXT}
            p = {w: shorter[(c[1:], w)] for w in listed}
            others, out = total - sum(listed.values()), max(1 - sum(p.values()), 1e-12)
            ratio = 2 * sum(m * math.log(m / (total * p[w])) for w, m in listed.items()) + (2 * others * math.log(others / (total * out)) if others else 0)
            if listed and ratio > len(listed) + 3 * math.sqrt(2 * len(listed)):
                share = {w: (m + PRIOR * p[w]) / (total + PRIOR) for w, m in listed.items()}
                level[c] = (max(1 - sum(share.values()), 1e-12) / out, share)
        if not level:
            return levels, root, UNSEEN / (n + UNSEEN * (v + 1))
        levels.append(level)
        shorter = {(c, w): p for c, (_, share) in level.items() for w, p in share.items()}


def score(s, levels, root, unseen):
    total = 0.0
    for i in range(1, len(s)):
        for k in range(min(len(levels), i), -1, -1):
            if k == 0:
                total += math.log10(root.get(s[i], unseen))
                break
            rest, share = levels[k - 1].get(tuple(s[i - k : i]), (1.0, {}))
            if s[i] in share:
                total += math.log10(share[s[i]])
                break
            total += math.log10(rest)
    return total


def corpus():
    rng = np.random.default_rng(3)
    rows = []
    for d in range(1500):
        out = [f"v{i}" for i in rng.zipf(1.4, 12) if i < 3000]
        if d % 50 == 0:
            out += ["sea", "of", "green", "glass"]
        if d % 3 == 0:
            x = int(rng.integers(0, 2))
            out += ["left" if x else "right", "a", "b", "one" if x else "two"]
        rows.append((d, " ".join(out)))
    return rows


@pytest.mark.parametrize("hot", [1 << 20, 30, 0])
@pytest.mark.parametrize("share", [1e-6, 1e-2])
def test_equals_brute_force(spark, monkeypatch, hot, share):
    monkeypatch.setattr(suffix_tree, "HOT", hot)
    monkeypatch.setattr(suffix_tree, "WORD_SHARE", share)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in scores(docs, context_count=LEAST, next_count=NEXT).collect()}
    sentences = {d: [None, *t.split(), None] for d, t in rows}
    levels, root, unseen = tree([s for d, s in sentences.items() if not got[d].held_out])
    assert len(levels) >= 3 and any(c[0] in ("left", "right") for c in levels[2])
    for d, s in sentences.items():
        assert got[d].score == pytest.approx(score(s, levels, root, unseen), abs=1e-6), d


def test_evidence_does_not_depend_on_the_size_of_the_input(spark):
    rng = np.random.default_rng(4)
    rows = [(d, " ".join(f"v{i}" for i in rng.integers(0, 200, 400))) for d in range(1500)] + [(9000 + d, "amber fox") for d in range(40)]
    got = {r.doc_id: r for r in scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # 40 of 600,000 tokens: below one in 10,000
    assert got[9000].score - got[9000].base_score > 3
