"""Document fingerprints: quartile codes of hashed byte-triplet counts, with a bounded difference score."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared
from millrace.llm.arrays import STEP_BYTES, steps

BUCKETS = 128
#: Offsets in a window of 5 bytes of the triplets that are counted.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
#: A difference from which two fingerprints are wholly unlike.
FARTHEST = 300
#: Rows of one range of doc_ids, about, while there are fewer than MOST_RANGES; beyond that ranges grow.
RANGE_ROWS, MOST_RANGES = 4_000, 1 << 15
#: Rows whose keys are drawn for the ends of the ranges, for each range.
DRAWN = 16


def digests(texts: list[bytes]) -> np.ndarray:
    """One row for each text: length code, two quartile ratios, then the code 0 to 3 of each bucket.

    Each window of 5 bytes counts its triplets in BUCKETS hashed buckets. The code of a bucket says between which
    quartiles of all buckets its count lies. A text of under 5 bytes has counts of 0, so only its length code tells.
    """
    out = np.zeros((len(texts), 3 + BUCKETS), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    off = np.concatenate([[0], np.cumsum(lengths)])
    whole = np.frombuffer(b"".join(texts), np.uint8)
    for a, b in steps(off):
        buf, edge, n = whole[off[a] : off[b]].astype(np.uint32), off[a : b + 1] - off[a], b - a
        counts = np.zeros(n * BUCKETS, np.int64)
        if len(buf) >= 5:
            place = np.repeat(np.arange(n) * BUCKETS, np.diff(edge))
            inside = np.arange(len(buf)) + 5 <= np.repeat(edge[1:], np.diff(edge))
            at = np.flatnonzero(inside)
            place = place[at]
            bytes_at = [buf[at + k] for k in range(5)]
            for salt, (i, j, k) in enumerate(TRIPLETS):
                x = (bytes_at[i] | (bytes_at[j] << 8) | (bytes_at[k] << 16)) * np.uint32(0x9E3779B1) + np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)
                x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                counts += np.bincount(place + (x >> np.uint32(25)), minlength=n * BUCKETS)
        counts = counts.reshape(n, BUCKETS)
        ordered = np.sort(counts, axis=1)
        q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
        out[a:b, 3:] = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
        out[a:b, 0] = np.minimum(255, np.round(8 * np.log2(lengths[a:b] + 1)))
        out[a:b, 1] = q1 * 15 // np.maximum(q3, 1)
        out[a:b, 2] = q2 * 15 // np.maximum(q3, 1)
    return out


def names(digest: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal text: 2 digits of length code, 1 for each ratio, 64 of bucket codes."""
    codes = digest[:, 3:].reshape(len(digest), BUCKETS // 4, 4)
    packed = (codes << np.array([6, 4, 2, 0], np.uint8)).sum(axis=2).astype(np.uint8)
    head = np.stack([digest[:, 0], digest[:, 1] << 4 | digest[:, 2]], axis=1)
    return [bytes(x).hex() for x in np.concatenate([head, packed], axis=1)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints, 0 from a difference of FARTHEST.

    Bucket codes count by their distance, opposite ends double; the length codes and ratios by theirs beyond one step,
    each up to 30.
    """
    x, y = a.astype(np.int64), b.astype(np.int64)
    gap = np.abs(x - y)
    codes = gap[:, 3:]
    head = np.minimum(30, np.where(gap[:, :3] <= 1, gap[:, :3], (gap[:, :3] - 1) * np.array([1, 4, 4])))
    return 1 - np.minimum(FARTHEST, codes.sum(axis=1) + 3 * (codes == 3).sum(axis=1) + head.sum(axis=1)) / FARTHEST


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@shared.lean
def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range and in order; each is compared with the row after it in its range."""
    held: list = []
    for batch in batches:
        columns = [batch.column(n) for n in ("range", "borrowed", "doc_id", "text")]
        first = 0
        sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in columns[3]])
        while first < batch.num_rows:
            past = (sizes[first - 1] if first else 0) + 4 * STEP_BYTES
            last = max(first + 1, int(np.searchsorted(sizes, past, "right")))
            rows = held + list(zip(*(c.slice(first, last - first).to_pylist() for c in columns), strict=True))
            first = last
            yield from _compared(rows)
            held = rows[-1:]


def _compared(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    at = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
    if not at:
        return
    own = digests([r[3].encode() for r in rows])
    half = [len(rows[i][3]) // 2 for i in at]
    edited = [(rows[i][3][: len(rows[i][3]) - h] + rows[i + 1][3][:h]).encode() for i, h in zip(at, half, strict=True)]
    changed = digests(edited)
    mine, after = own[at], own[[i + 1 for i in at]]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][2] for i in at], pa.int64()),
            pa.array([len(rows[i][3]) for i in at], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
            pa.array(names(mine)),
            pa.array(names(changed)),
            pa.array(likeness(mine, changed)),
            pa.array(likeness(mine, after)),
        ],
        _NAMES,
    )


def _ranges(keys: list[int | None], ranges: int) -> tuple[list[float], list[tuple[int, int, int]]]:
    """Cuts of the doc_ids, rising, and for each bucket between them, and for null (the last), its number, the first of
    its ranges, and how many ranges it is split into by the hash of the text.

    ``keys`` are drawn doc_ids. Buckets follow the order of rows, doc_ids falling and null last. A doc_id that
    holds several shares of the rows alone, and null, become a bucket of their own with as many ranges.
    """
    ids = sorted(i for i in keys if i is not None)
    share = max(1, len(keys) // ranges)
    ends = [ids[k] for k in range(share, len(ids), share)]
    cuts, alone = set(), {}
    for i in ends:
        cuts.add(i)
        alone[i] = alone.get(i, 0) + 1
    alone = {float(i): n for i, n in alone.items() if n > 1 and float(i) < float(i + 1)}  # doubles hold it apart
    cuts = sorted({float(i) for i in cuts} | {i + 1 for i in alone})
    table, at = [], 0
    for bucket in range(len(cuts), -1, -1):  # bucket b holds doc_ids from cut b - 1 to below cut b
        n = alone.get(cuts[bucket - 1], 1) if bucket else 1
        table.append((bucket, at, n))
        at += n
    nulls = len(keys) - len(ids)
    table.append((-1, at, max(1, nulls // share)))
    return cuts, table


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one before in doc_id order, after the last the first. Rows of one doc_id follow by a hash
    of their text; rows without doc_id come last. Ranges of doc_ids, and of hashes where one doc_id or null holds many
    rows, go to one task each, in order, and the first row of a range goes to the range before it as well, so no row
    passes through more than two tasks. The driver sees DRAWN keys and one row for each of MOST_RANGES ranges at most. A
    single row is its own next. Null texts are empty; an empty table gives no rows; other columns are not read.
    """
    shared.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    n = docs.count()
    ranges = min(MOST_RANGES, max(1, -(-n // RANGE_ROWS)))
    cuts, table = [], [(0, 0, 1), (-1, 1, 1)]
    if ranges > 1:
        drawn = F.rand(1) < F.lit(DRAWN * ranges / n)  # which keys are drawn moves the ends of ranges, not the result
        cuts, table = _ranges(rows.select("doc_id").filter(drawn).toArrow().column(0).to_pylist(), ranges)
    bucket = F.lit(0)
    if cuts:
        cut = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="place", outputCol="at")
        rows = cut.transform(rows.withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))).drop("place")
        bucket = F.col("at").cast("int")
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bucket))
    split = spark.createDataFrame(table, "bucket int, base int, parts int")
    part = F.least(F.floor((F.shiftright("text_hash", 1) / F.lit(float(1 << 63)) + 0.5) * F.col("parts")).cast("int"), F.col("parts") - 1)
    placed = rows.join(F.broadcast(split), "bucket").select("doc_id", "text", "text_hash", (F.col("base") + part).alias("range"))

    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("falling"), F.col("text_hash"))
    tops = sorted(tuple(r) for r in placed.groupBy("range").agg(F.min(order).alias("top")).select("range", "top.*").collect())
    lends = [(*top, tops[k - 1][0]) for k, top in enumerate(tops)]
    lends = spark.createDataFrame(lends, "range int, no_id boolean, falling long, text_hash long, to int")
    keyed = placed.select("*", order.no_id.alias("no_id"), order.falling.alias("falling"))
    borrowed = keyed.join(F.broadcast(lends), ["range", "no_id", "falling", "text_hash"]).dropDuplicates(["to"])
    dealt = keyed.withColumn("borrowed", F.lit(0)).drop("no_id", "falling").unionByName(borrowed.select("doc_id", "text", "text_hash", F.col("to").alias("range"), F.lit(1).alias("borrowed")))
    dealt = dealt.repartitionById(max(1, tops[-1][0] + 1 if tops else 1), F.col("range")).sortWithinPartitions("range", "borrowed", F.col("doc_id").desc_nulls_last(), "text_hash", "text")
    return dealt.select("range", "borrowed", "doc_id", "text").mapInArrow(_in_order, _SCHEMA)
