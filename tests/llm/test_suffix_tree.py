from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import partial
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import slots, suffix_tree
from millrace.llm.arrays import steps
from millrace.llm.suffix_tree import END, scores


def tokens(text):
    return [w for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))] + [None]


def fixture():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for d in range(400):
        out, last = [], 0
        for _ in range(int(rng.integers(0, 60))):
            last = (last * 3 + 1) % 40 if rng.random() < 0.6 else int(rng.integers(0, 40))
            out.append(vocabulary[last].upper() if rng.random() < 0.2 else vocabulary[last])
        rows.append((d, " ".join(out) + (f" rare{d % 50}é" if d % 3 else "")))
    return [*rows, (1000, None), (1001, ""), (1002, "new " * 9000)]


@pytest.mark.parametrize("share", [1e-6, 1e-3])
def test_counts_and_base_scores(spark, monkeypatch, share):
    monkeypatch.setattr(suffix_tree, "WORD_SHARE", share)
    rows = fixture()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int").repartition(3)
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    c = Counter(w for d, t in rows if not held[d] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in scores(docs).collect()}
    for d, t in rows:
        w, r = tokens(t), got[d]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base, abs=1e-6)
    tested = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in tested) > 0.8 * sum(r.base_score for r in tested)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(fixture()[:400], "doc_id long, text string").select("text")
    counts = docs.mapInArrow(suffix_tree._counted, "word long, n long").groupBy("word").sum("n").toDF("word", "n")
    n, v = counts.selectExpr("sum(n)", "count(*)").first()
    model = suffix_tree.fit(docs, counts, n, v)
    assert len(model.levels[0].contexts) and len(model.levels[1].contexts)
    for history in ([], [model.words[0]], list(model.words[3:5]), [model.words[1], model.words[7]]):
        total = 0.1 / (n + 0.1 * (v + 1))
        for k, w in enumerate(model.words):
            seq = np.array([*history, w], np.uint64)
            beyond, _ = model.scores(seq, np.array([0]))
            total += 10 ** (beyond[-1] + model.root[k])
        unseen = np.array([*history, np.uint64(12345)], np.uint64)
        total += (10 ** model.scores(unseen, np.array([0]))[0][-1] - 1) * 0.1 / (n + 0.1 * (v + 1))
        assert total == pytest.approx(1, abs=1e-6)
    assert END in model.words


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    assert scores(docs.limit(0)).collect() == []
    assert Counter((r.doc_id, r.n_tokens) for r in scores(docs).collect()) == Counter({(None, 3): 1, (1, 3): 2, (2, 1): 1})


@pytest.mark.parametrize("n_ranked", [0, 5, 42])
def test_pairs_of_words_in_memory_are_one_number(monkeypatch, n_ranked):
    monkeypatch.setattr(suffix_tree, "COUNTED_PAIRS", 500)
    monkeypatch.setattr(suffix_tree, "steps", partial(steps, most=2000))
    texts = [t for _, t in fixture()[:200]]
    least = {w for w, n in Counter(w for t in texts for w in tokens(t)).items() if n >= 20}
    key = lambda w: END if w is None else suffix_tree.hashes(*(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())])))[0]
    known = np.zeros(slots.BITS // 32, np.uint32)
    for k in map(key, least):
        slot = int(k) % slots.BITS
        known[slot >> 5] |= np.uint32(1 << (slot & 31))
    words = np.sort(np.array([key(w) for w in sorted(least, key=str)][:n_ranked], np.uint64))
    ranks = suffix_tree.Ranks.of(words, np.arange(len(words)) % 7)
    shared = SimpleNamespace(value=(known, known, ranks))
    rows = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = list(suffix_tree._pairs(iter([rows, rows]), shared))
    assert len(got) > 2
    inside = set(words.tolist())
    for b in got:
        context, up = (b.column(c).to_numpy().view(np.uint64) for c in ("context", "up"))
        coded = up == suffix_tree.RANKS
        assert (context[coded] < 2**52).all()
        assert not any(int(c) in inside and int(u) in inside for c, u in zip(context[~coded], up[~coded], strict=True))
        assert coded.any() == (n_ranked > 0)
    want = Counter()
    for t in texts:
        w = [None, *tokens(t)]
        want.update((int(key(x)), int(key(y))) for x, y in zip(w, w[1:], strict=False) if {x, y} <= least)
    found = Counter()
    for b in suffix_tree._unranked(iter(got), shared):
        context, up = (b.column(c).to_numpy().view(np.uint64).tolist() for c in ("context", "up"))
        for c, u, n in zip(context, up, b.column("n").to_pylist(), strict=True):
            found[c, u] += n
    assert found == {k: 2 * n for k, n in want.items()}


def test_shuffles_of_saved_tables_and_broadcasts_are_gone(spark):
    """What is left on disk for the result must not wait for the driver's garbage collector."""
    folders = [Path(str(d)) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    left = lambda: {f: f.stat().st_size for d in folders for f in d.rglob("*") if f.name.startswith("shuffle_") and f.suffix == ".data"}
    docs = spark.createDataFrame([(d, " ".join(f"u{d * k % 9973}" for k in range(200))) for d in range(300)], "doc_id long, text string")
    before = left()
    result = scores(docs)
    new = sum(size for f, size in left().items() if f not in before)
    words = docs.mapInArrow(suffix_tree._counted, "word long, n long").groupBy("word").sum("n")
    before = left()
    words.collect()
    assert new < sum(size for f, size in left().items() if f not in before)
    assert result.count() == 300
