from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from millrace.llm import shared

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def test_stages_and_run_agree(spark):
    docs = shared.documents(spark, SF)
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.save(stage(spark, docs, SF), "test-stage")
        counts.append(docs.count())
        if name != "encoding":
            assert docs.columns == columns
        if name == "exact dedup":
            texts = [r.text for r in docs.collect()]
            assert len(texts) == len(set(texts))
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[5] == counts[4] > 0
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, docs.collect()))


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stage_on_odd_rows(spark, number):
    """Null and repeated ids, null, empty and very long texts, equal rows, and columns named as the stages' own."""
    name, stage = corpus_pipeline.STAGES[number]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, node long, root long, digest string, role int"
    rest = ("en", "s", 1, "x", "y", 1, 2, "z", 0)
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, *rest), (1, text, *rest), (1, "other words altogether here now", *rest), (None, None, None, None, None, None, None, None, None, None, None), (None, text, *rest), (2, "", *rest), (3, "é" * 200_000, *rest), (4, text + " more", *rest), (5, "few words", *rest)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    out = stage(spark, docs, SF)
    got = out.collect()
    if name == "encoding":
        assert len(got) == len(rows)
    else:
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert set(map(tuple, got)) <= set(rows)
    if name == "exact dedup":
        assert sorted(r.text or "" for r in got) == sorted({t or "" for _, t, *_ in rows})
    if name == "near dedup":
        assert sum((r.text or "").startswith("w0 w1") for r in got) == 1
    empty = stage(spark, docs.limit(0), SF)
    assert empty.collect() == [] and (name == "encoding" or empty.columns == docs.columns)


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
