from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import mixing


def water(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(900):
        source = ["hot", "hot", "b", "ü", None, "tiny", "none"][int(rng.integers(0, 5))] if i else "tiny"
        out.append((i, " ".join(["w"] * int(rng.integers(0, 60))) if i % 17 else None, source, "x"))
    return [*out, (5000, "", "none", None), (5, "w w", "b", "x"), (5, "w w", "b", "x"), (None, "w\tw", None, None)]


@pytest.mark.parametrize("bucket", [4_000, 10])
def test_targets_and_bounds(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(mixing, "FAN_IN", 3 if bucket == 10 else 64)
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, size string")
    got = mixing.copies(docs).collect()
    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, size(t), s) for i, t, s, _ in rows())
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    target = water(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    again = mixing.copies(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_rounding_keeps_mass_and_means():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 50, 40).astype(float)
    sums = np.zeros(40)
    for _ in range(2000):
        part, held = mixing.round_pairwise(np.full(40, 0.3), size, rng)
        assert part @ size == pytest.approx(0.3 * size.sum())
        assert all(p in (0.0, 1.0) for i, p in enumerate(part) if i != held)
        sums += part
    assert np.abs(sums / 2000 - 0.3).max() < 0.06


def test_many_equal_rows_are_spread_over_buckets(spark):
    docs = spark.range(100_000).selectExpr("cast(null as long) doc_id", "'w w w' text", "'s' source")
    others = spark.range(2_000).selectExpr("id doc_id", "'x y' text", "if(id % 2 = 0, 'a', 'b') source")
    got = mixing.copies(docs.unionByName(others)).groupBy("source").agg({"taken": "sum", "target": "max", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in got) == 102_000
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 1.5


def test_last_open_document_passes_its_mass_on():
    size = np.array([900.0, 400.0, 90.0, 40.0, 8.0, 3.0])
    part = mixing.settle(np.array([0.0, 0.37, 1.0, 0.0, 0.0, 0.0]), size, 1)
    assert set(part) <= {0.0, 1.0} and part[2] == 1 and abs(part @ size - 90 - 0.37 * 400) <= 200
    part = mixing.settle(np.array([0.5, 0.0, 0.0, 0.0, 0.0, 0.0]), size, 0)
    assert abs(part @ size - 450) <= 1.5


def test_mixed_rows_and_empty(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, size string")
    plan = mixing.copies(docs)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r.source for r in out.collect()) == Counter({s: n for s, n in plan.groupBy("source").sum("copies").collect() if n})
    assert mixing.copies(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []
