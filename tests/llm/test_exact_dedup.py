from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

from millrace.llm.exact_dedup import exact_duplicates, keep_one_of_each

ROWS = [(1, "a b", "x"), (2, "a b", "x"), (3, "a  b", "y"), (4, None, "y"), (5, "", None), (6, "ü" * 5000, "z"), (2, "a b", "x"), (None, "only here", "q"), (None, "a b", "q"), (7, "end", "e")]
NAMES = "doc_id long, text string, digest string"


def expected(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            mine = i == keep and not kept
            kept |= mine
            out[i, keep, len(ids), mine, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def test_matches_brute_force_over_several_batches(spark):
    docs = spark.createDataFrame(ROWS * 3 + [(100 + i, f"t{i % 7}", None) for i in range(50)], NAMES).repartition(5)
    want = expected([tuple(r) for r in docs.collect()])
    assert Counter(map(tuple, exact_duplicates(docs, files_per_batch=1).collect())) == want


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], NAMES)).collect() == []


def test_kept_rows_have_all_columns(spark):
    docs = spark.createDataFrame(ROWS, NAMES)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text or "" for r in kept.collect())) == sorted({t or "" for _, t, _ in ROWS})
    assert {r.doc_id for r in kept.collect() if r.text == "a b"} == {2}
