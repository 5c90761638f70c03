from __future__ import annotations

import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from millrace.llm import positive_unlabelled as pu
from millrace.llm import quality, toxicity

DATA = Path("/root/testdata")


def auc(score, one):
    order = np.argsort(score, kind="stable")
    _, group = np.unique(score, return_inverse=True)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    rank = (np.bincount(group, rank) / np.bincount(group))[group]
    return (rank[one].mean() - (one.sum() - 1) / 2) / (~one).sum()


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize(
    ("module", "label", "parts", "part", "size", "least_auc", "recall", "false"),
    [
        (toxicity.toxicity, "toxic", 3, 1, "sf0.01", 0.9, 0.6, 0.05),
        (toxicity.toxicity, "toxic", 3, 1, "sf0.1", 0.95, 0.9, 0.05),
        (quality.quality, "quality", 4, 2, "sf0.01", 0.88, 0.95, 0.9),
        (quality.quality, "quality", 4, 2, "sf0.1", 0.99, 0.98, 0.08),
    ],
)
def test_held_out_labels(spark, module, label, parts, part, size, least_auc, recall, false):
    docs, labels = (spark.read.parquet(f"{DATA}/{size}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in module(docs, labels).collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    marks = [(r.doc_id, r[label]) for r in labels.collect() if got[r.doc_id].held_out]
    score, one = np.array([got[d].score for d, _ in marks]), np.array([y == 1 for _, y in marks])
    predicted = np.array([got[d].predicted for d, _ in marks]) == 1
    found = auc(score, one), predicted[one].mean(), predicted[~one].mean()
    assert found[0] >= least_auc and found[1] >= recall and found[2] <= false, found


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 1.0), (1, "a b", 2.0), (None, "x", 0.0), (2, None, 0.0), (3, "", 0.0), (4, "é" * 40000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter({1: 2, None: 1, 2: 1, 3: 1, 4: 1})
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    assert len(toxicity.toxicity(docs, labels.limit(0)).collect()) == 6
    kept = toxicity.without_toxic(docs, labels)
    assert kept.schema == docs.schema and kept.count() <= 6


def test_fit_finds_the_planted_feature():
    rng = np.random.default_rng(0)
    n, positive = 3000, np.arange(3000) < 800
    toxic = positive | (rng.random(n) < 0.2)
    row = np.concatenate([np.flatnonzero(toxic), np.repeat(np.arange(n), 5)])
    feature = np.concatenate([np.full(toxic.sum(), 7), rng.integers(10, 500, 5 * n)])
    columns = np.unique(feature)
    model = pu.fit(row, feature, positive, 0.2, columns, np.ones(len(columns)))
    score = model.score(row, feature, n)
    assert score[toxic].min() > score[~toxic].max()
