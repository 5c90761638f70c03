"""The registered queries of the training-data operators, with production parameters, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, bucket_digest, exact_dedup, line_dedup, mixing, near_dedup, quality, repeated_bytes, suffix_tree, toxicity
from millrace.llm.shared import documents


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeated_bytes.without_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scores(documents(spark, sf_dir), depth=5, context_count=512, next_count=16)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_digest.fingerprints(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeated_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_near_dedup": op4_near_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_lm_scores": op6_lm_scores,
    "op7_toxicity": op7_toxicity,
    "op8_fingerprints": op8_fingerprints,
    "op9_line_dedup": op9_line_dedup,
    "op10_bpe": op10_bpe,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op1_suffix_dedup": """
        WITH h AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
        ), s AS MATERIALIZED (
            SELECT doc_id, i, md5(substring(x, 2 * i + 1, 448)) AS near, CASE WHEN i + 400 <= n THEN md5(substring(x, 2 * i + 1, 800)) END AS far
            FROM (SELECT doc_id, x, n, unnest(range(0, n - 223)) AS i FROM h)
        ), starts AS (
            SELECT doc_id, i, 224 AS length FROM s WHERE near IN (SELECT near FROM s GROUP BY near HAVING count(*) > 1)
            UNION ALL SELECT doc_id, i, 400 FROM s WHERE far IN (SELECT far FROM s WHERE far IS NOT NULL GROUP BY far HAVING count(*) > 1)
        ), marked AS (
            SELECT doc_id, length, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, length ORDER BY i) + length THEN 0 ELSE 1 END AS opens FROM starts
        ), numbered AS (
            SELECT doc_id, length, i, sum(opens) OVER (PARTITION BY doc_id, length ORDER BY i) AS span FROM marked
        ), spans AS (
            SELECT doc_id, length, min(i) AS a, max(i) + length AS b FROM numbered GROUP BY doc_id, length, span
        ), pieces AS (
            SELECT doc_id, a AS place, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, a AS to_ FROM spans WHERE length = 400
            UNION ALL SELECT h.doc_id, h.n, coalesce(max(b), 0), h.n FROM h LEFT JOIN spans ON spans.doc_id = h.doc_id AND length = 400 GROUP BY h.doc_id, h.n
        ), kept AS (
            SELECT doc_id, string_agg(substring(x, 2 * from_ + 1, 2 * (to_ - from_)), '' ORDER BY place, from_) AS x FROM pieces JOIN h USING (doc_id) GROUP BY doc_id
        ), sums AS (
            SELECT doc_id, sum(b - a) FILTER (WHERE length = 400) AS n_removed, count(*) FILTER (WHERE length = 400) AS n_spans, sum(b - a) FILTER (WHERE length = 224) AS n_repeated FROM spans GROUP BY doc_id
        )
        SELECT h.doc_id, h.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(kept.x)) AS kept_sha256, coalesce(n_repeated, 0)::BIGINT AS n_repeated
        FROM h JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
    """,
    "op8_fingerprints": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
                   coalesce(lead(doc_id) OVER falling, first_value(doc_id) OVER falling) AS next_id,
                   coalesce(lead(coalesce(text, '')) OVER falling, first_value(coalesce(text, '')) OVER falling) AS next_text
            FROM documents WINDOW falling AS (ORDER BY doc_id DESC)
        ), t AS MATERIALIZED (
            SELECT doc_id, 0 AS edited, text FROM d UNION ALL SELECT doc_id, 1, left(text, n - n // 2) || left(next_text, n // 2) FROM d
        ), bytes AS (
            SELECT doc_id, edited, i, ('0x' || substring(x, 2 * i + 1, 2))::UBIGINT AS v FROM (SELECT doc_id, edited, hex(encode(text)) AS x, unnest(range(0, octet_length(encode(text)))) AS i FROM t)
        ), five AS (
            SELECT doc_id, edited, v AS a, lead(v, 1) OVER w AS b, lead(v, 2) OVER w AS c, lead(v, 3) OVER w AS d, lead(v, 4) OVER w AS e FROM bytes WINDOW w AS (PARTITION BY doc_id, edited ORDER BY i)
        ), triplets AS (
            SELECT doc_id, edited, unnest([a + b * 256 + c * 65536, a + b * 256 + d * 65536, a + c * 256 + d * 65536, a + c * 256 + e * 65536, a + b * 256 + e * 65536, a + d * 256 + e * 65536]) AS x,
                   unnest([0, 2246822507, 4493645014, 6740467521, 8987290028, 11234112535]) AS salt
            FROM five WHERE e IS NOT NULL
        ), mixed AS (
            SELECT doc_id, edited, ((x * 2654435761 + salt) % 4294967296)::UBIGINT AS x FROM triplets
        ), counted AS (
            SELECT doc_id, edited, (((xor(x, x >> 15) * 739982445) % 4294967296) >> 25)::INTEGER AS bucket, count(*) AS n FROM mixed GROUP BY ALL
        ), counts AS (
            SELECT t.doc_id, t.edited, octet_length(encode(t.text)) AS size, list(coalesce(c.n, 0) ORDER BY k) AS n
            FROM t CROSS JOIN range(128) AS r(k) LEFT JOIN counted c ON c.doc_id = t.doc_id AND c.edited = t.edited AND c.bucket = k GROUP BY t.doc_id, t.edited, t.text
        ), quartiles AS (
            SELECT *, list_sort(n)[32] AS q1, list_sort(n)[64] AS q2, list_sort(n)[96] AS q3 FROM counts
        ), digests AS (
            SELECT doc_id, edited, [least(255, round(8 * log2(size + 1)))::INTEGER, (q1 * 15 // greatest(q3, 1))::INTEGER, (q2 * 15 // greatest(q3, 1))::INTEGER] AS head,
                   list_transform(n, lambda m: (m > q1)::INTEGER + (m > q2)::INTEGER + (m > q3)::INTEGER) AS codes FROM quartiles
        ), prints AS MATERIALIZED (
            SELECT *, printf('%02x%x%x', head[1], head[2], head[3]) || list_aggregate(list_transform(range(1, 129, 4), lambda k: printf('%02x', codes[k] * 64 + codes[k + 1] * 16 + codes[k + 2] * 4 + codes[k + 3])), 'string_agg', '') AS fingerprint FROM digests
        ), pairs AS (
            SELECT d.doc_id, d.n, o.fingerprint, e.fingerprint AS edited_fingerprint, unnest([o.head, o.head]) AS mine_head, unnest([o.codes, o.codes]) AS mine, unnest([e.head, x.head]) AS other_head, unnest([e.codes, x.codes]) AS other, unnest([0, 1]) AS which
            FROM d JOIN prints o ON o.doc_id = d.doc_id AND o.edited = 0 JOIN prints e ON e.doc_id = d.doc_id AND e.edited = 1 JOIN prints x ON x.doc_id = d.next_id AND x.edited = 0
        ), gaps AS (
            SELECT *, list_transform(range(1, 129), lambda k: abs(mine[k] - other[k])) AS gap, list_transform(range(1, 4), lambda k: abs(mine_head[k] - other_head[k])) AS head_gap FROM pairs
        ), near AS (
            SELECT *, 1 - least(300, list_sum(gap) + 3 * len(list_filter(gap, lambda g: g = 3)) + list_sum(list_transform(range(1, 4), lambda k: least(30, CASE WHEN head_gap[k] <= 1 THEN head_gap[k] ELSE (head_gap[k] - 1) * [1, 4, 4][k] END))))::DOUBLE / 300 AS likeness FROM gaps
        )
        SELECT near.doc_id, n::BIGINT AS n_chars, any_value(sha256(t.text)) AS edited_sha256, fingerprint, edited_fingerprint, max(likeness) FILTER (WHERE which = 0) AS near_edited, max(likeness) FILTER (WHERE which = 1) AS near_next
        FROM near JOIN t ON t.doc_id = near.doc_id AND t.edited = 1 GROUP BY near.doc_id, n, fingerprint, edited_fingerprint
    """,
    "op9_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, i AS nth, ls[i] AS line, len(ls) AS n_lines FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
        ), firsts AS MATERIALIZED (
            SELECT line, min(row(doc_id, nth)) AS place, length(line) AS n FROM l WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY line
        ), halves AS (
            SELECT f.line, f.place, f.n, s AS short, k, CASE k WHEN 0 THEN left(f.line, s // 2) ELSE right(f.line, s - s // 2) END AS half
            FROM firsts f, unnest([f.n, f.n - 1]) AS a(s), unnest([0, 1]) AS b(k) WHERE f.n >= 15
        ), near AS (
            SELECT DISTINCT a.place FROM halves a JOIN halves b ON a.short = b.short AND a.k = b.k AND a.half = b.half AND b.place < a.place
            WHERE greatest(a.n, b.n) >= 16 AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) <= 1
        ), stays AS (
            SELECT row(doc_id, nth) IN (SELECT place FROM firsts WHERE place NOT IN (SELECT place FROM near)) OR NOT regexp_matches(line, '[^ \t\n\x0B\f\r]') AS stays, * FROM l
        )
        SELECT doc_id, any_value(n_lines)::BIGINT AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE stays), '')) AS kept_sha256
        FROM stays GROUP BY doc_id
    """,
    "op4_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END) AS g FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
        ), e AS (
            SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
        ), f AS (
            SELECT x, y FROM e UNION ALL SELECT y, x FROM e
        ), r(doc_id, root) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT f.y, r.root FROM r JOIN f ON f.x = r.doc_id
        )
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
        FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
    """,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
