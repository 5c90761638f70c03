from __future__ import annotations

from collections import Counter

from millrace.llm.near_dedup import keep_one_of_each, near_duplicates

A = " ".join(f"a{i}" for i in range(60))
B = " ".join(f"b{i}" for i in range(60))


def test_null_ids_and_one_id_with_two_texts(spark):
    rows = [(None, A), (None, A), (None, A + " x"), (7, B), (7, "far from all others"), (8, B + " x"), (9, "far from all others too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == Counter([(None, None, True)] * 3 + [(7, 7, True)] * 2 + [(8, 7, False), (9, 9, True)])
    kept = Counter(map(tuple, keep_one_of_each(docs, 3, 85).collect()))
    assert sum(n for (d, _), n in kept.items() if d is None) == 1
    assert Counter({k: n for k, n in kept.items() if k[0] is not None}) == Counter([(7, B), (7, "far from all others"), (9, "far from all others too")])


def test_null_id_links_near_copy_with_id_and_other_text_of_kept_id_goes(spark):
    rows = [(None, A), (5, A + " x"), (3, B), (5, B + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == Counter([(None, 5, False), (5, 5, True), (3, 3, True), (5, 3, False)])
    assert Counter(map(tuple, keep_one_of_each(docs, 3, 85).collect())) == Counter([(5, A + " x"), (3, B)])
