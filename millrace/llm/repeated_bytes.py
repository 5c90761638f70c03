"""Removal of repeated byte strings, by a parse of the corpus into phrases that end at rolling-hash triggers.

Each start of a string of LEAST bytes belongs to the phrase of its trigger: the leftmost place among the next WINDOW
whose rolling hash of GRAM bytes is least. The trigger depends on the string alone, so equal strings have triggers at
equal distances. The starts of one trigger form a run; the context of a run is the text from its first start to LENGTH
bytes past its last, or to the end of its text. Equal contexts are one entry of the dictionary, and the parse says where each entry stands. Only
entries that share the bytes right of the trigger with a different entry are ordered by their single strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared, slots
from millrace.llm.arrays import hashes, long, mix, steps, texts

#: Bytes of a string that is removed where it repeats, and of one that is reported; starts that share a trigger at most;
#: bytes of a trigger.
LENGTH, LEAST, WINDOW, GRAM = 400, 224, 128, 8
#: Bytes right of a trigger that every string of its run holds.
CORE = LEAST + 1 - WINDOW

#: Strings in the contexts of one core that one task sorts; a core with more has them counted by a shuffle.
OFTEN = 1 << 17

_ROW = "doc_id long, text_hash long"


def runs(buf: np.ndarray, off: np.ndarray, length: int = LEAST, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigger, first start and last start of each run, in order; starts whose string would pass its row's end have none."""
    if len(buf) < length:
        return (np.zeros(0, np.int64),) * 3
    n = len(buf) - GRAM + 1
    grams = np.ndarray((n,), "<u8", buf.tobytes(), strides=(1,))
    place = np.arange(n, dtype=np.uint64)
    keys = (mix(grams.astype(np.uint64)) & np.uint64(0xFFFFFFFF00000000)) | place
    blocks = -(-n // window)
    padded = np.full(blocks * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    padded = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    starts_row = np.repeat(off[1:], np.diff(off))
    start = np.flatnonzero(np.arange(len(buf)) + length <= starts_row)
    trigger = (np.minimum(behind[start], ahead[start + window - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(start), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return trigger[first], start[first], start[last]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        buf, off = texts(batch.column("text"))
        for a, b in steps(off):
            yield batch, a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]


@shared.lean
def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, buf, off in _slices(batches):
        trigger, _, _ = runs(buf, off)
        yield pa.RecordBatch.from_arrays([pa.array(long(hashes(buf, trigger, trigger + CORE)))], ["core"])


@shared.lean
def _contexts(batches: Iterator[pa.RecordBatch], seen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The runs whose core may be repeated: where they stand, their core, and a digest of context and place of trigger."""
    for batch, a, _, buf, off in _slices(batches):
        trigger, first, last = runs(buf, off)
        core = long(hashes(buf, trigger, trigger + CORE))
        some = np.flatnonzero(slots.among(seen, core))
        raw = buf.tobytes()
        row = np.searchsorted(off, first[some], "right") - 1
        end = np.minimum(last[some] + LENGTH, off[row + 1])
        digest = [xxhash.xxh3_64_intdigest(raw[f:e], (t - f) << 32 | n) for t, f, e, n in zip(trigger[some].tolist(), first[some].tolist(), end.tolist(), (last - first)[some].tolist(), strict=True)]
        at = pa.array(row + a)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(core[some]), pa.array(long(np.array(digest, np.uint64))), pa.array(first[some] - off[row]), pa.array(last[some] - off[row])],
            ["doc_id", "text_hash", "core", "context", "first", "last"],
        )


@shared.lean
def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each context that a row of text stands for, with the columns of its run."""
    for batch in batches:
        for i in range(batch.num_rows):
            raw, listed = batch.column("text")[i].as_buffer().to_pybytes(), batch.column("runs")[i].as_py()
            row = pa.array(np.full(len(listed), i))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("text_hash").take(row), *(pa.array([r[k] for r in listed], pa.int64()) for k in ("core", "strings", "times", "first", "last")), pa.array([raw[r["first"] : r["last"] + LENGTH] for r in listed], pa.binary())],
                ["doc_id", "text_hash", "core", "strings", "times", "first", "last", "context"],
            )


def _starts(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many starts each context has, and for each start its context and its place there."""
    n = rows.column("last").to_numpy() - rows.column("first").to_numpy() + 1
    return n, np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


@shared.lean
def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each start in the contexts of a core that is too frequent for one task: 128-bit digests of its LEAST and
    of its LENGTH bytes, the latter null where the text ends before."""
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            contexts = part.column("context").to_pylist()
            n, row, place = _starts(part)
            whole = place + LENGTH <= np.array([len(c) for c in contexts], np.int64)[row] if len(n) else np.zeros(0, bool)
            keys = []
            for length in (LEAST, LENGTH):
                raw = b"".join([xxhash.xxh3_128_digest(c[i : i + length]) for c, k in zip(contexts, n.tolist(), strict=True) for i in range(k)])
                keys += list(np.frombuffer(raw, "<i8").reshape(-1, 2).T)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(at), part.column("text_hash").take(at), *(pa.array(k.copy()) for k in keys[:2]), *(pa.array(k.copy(), mask=~whole) for k in keys[2:]), pa.array(part.column("first").take(at).to_numpy() + place), part.column("times").take(at)],
                ["doc_id", "text_hash", "k1", "k2", "q1", "q2", "at", "times"],
            )


@shared.lean
def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of starts, in contexts that stand once, of strings that another context of the same core has too.

    Rows come in the order of their cores; a batch's last core waits for the next batch, and has OFTEN strings at most.
    """
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        if not len(rows):
            continue
        core = rows.column("core").to_numpy()
        whole = int(np.searchsorted(core, core[-1]))
        held = rows.slice(whole)
        for a in _core_steps(core[:whole]):
            yield _ranges(rows.slice(*a))
    if held is not None:
        yield _ranges(held)


def _core_steps(core: np.ndarray, most: int = 300) -> Iterator[tuple[int, int]]:
    """Parts (place, length) of about ``most`` rows that don't split a core."""
    first = 0
    while first < len(core):
        last = int(np.searchsorted(core, core[min(first + most, len(core)) - 1], "right"))
        yield first, last - first
        first = last


def _suffix_order(contexts: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of some contexts of ``n`` starts, whose strings are ordered by their LENGTH bytes, and whether each
    has its first LEAST, and its first LENGTH, bytes in common with the one before it. All have LEAST bytes."""
    full = n - 1 + LENGTH
    size = np.array([len(c) for c in contexts], np.int64)
    whole = np.frombuffer(b"".join([c if k == f else c.ljust(f, b"\0") for c, k, f in zip(contexts, size.tolist(), full.tolist(), strict=True)]), np.uint8)
    begin = np.cumsum(full) - full
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    views = np.lib.stride_tricks.as_strided(whole, (len(whole) - LENGTH + 1, LENGTH), (1, 1))
    strings = views[np.repeat(begin, n) + place]
    ends = np.minimum(LENGTH, np.repeat(size, n) - place)
    by_end = np.argsort(ends, kind="stable")
    order = by_end[np.argsort(strings[by_end].view(f"S{LENGTH}").ravel(), kind="stable")]
    strings, ends = strings[order], ends[order]
    same = strings[1:] == strings[:-1]
    least, all_ = np.zeros(len(order), bool), np.zeros(len(order), bool)
    least[1:] = same[:, :LEAST].all(axis=1)
    all_[1:] = same.all(axis=1) & (ends[1:] == LENGTH) & (ends[:-1] == LENGTH)
    return order, least, all_


def _ranges(rows: pa.Table) -> pa.RecordBatch:
    contexts = rows.column("context").to_pylist()
    n, row, at = _starts(rows)
    times = rows.column("times").to_numpy()[row]
    order, *common = _suffix_order(contexts, n)
    table = rows.combine_chunks()
    start = rows.column("first").to_numpy()
    out: list[list] = [[], [], [], [], []]
    for length, same in zip((LEAST, LENGTH), common, strict=True):
        group = np.cumsum(~same) - 1
        again = np.zeros(len(order), bool)
        again[order] = np.bincount(group, times[order])[group] > 1
        if length == LENGTH:  # a start whose string the text's end cuts off has no mate of this length
            again &= at + LENGTH <= np.array([len(c) for c in contexts], np.int64)[row]
        some = np.flatnonzero(again & (times == 1))
        if not len(some):
            continue
        opens = np.ones(len(some), bool)
        opens[1:] = (some[1:] != some[:-1] + 1) | (row[some][1:] != row[some][:-1])
        heads = some[opens]
        tails = some[np.append(np.flatnonzero(opens)[1:] - 1, len(some) - 1)]
        of = pa.array(row[heads])
        first = start[row[heads]]
        for column, value in zip(out, (*(pa.concat_arrays(table.column(c).chunks).take(of) for c in ("doc_id", "text_hash")), pa.array(first + at[heads]), pa.array(first + at[tails]), pa.array(np.full(len(heads), length))), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) if x else pa.array([], pa.int64()) for x in out], ["doc_id", "text_hash", "first", "last", "length"])


def covered(first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal byte runs that the strings starting at first .. last cover."""
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate((last + length)[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)] if len(end) else end


@shared.lean
def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            raw = text.as_buffer().to_pybytes()
            kept, n_spans, gone, repeated = raw, 0, 0, 0
            if spans.is_valid:
                first, last, length = (np.asarray(v, np.int64) for v in spans.values.flatten())
                start, end = covered(first, np.minimum(last, len(raw) - LEAST), LEAST)
                repeated = int((end - start).sum())
                last = np.minimum(last, len(raw) - LENGTH)
                long_ = (length == LENGTH) & (first <= last)
                start, end = covered(first[long_], last[long_])
                cuts = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                n_spans, gone = len(start), len(raw) - len(kept)
            for column, value in zip(out, (len(raw), gone, n_spans, repeated, kept), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated", "kept"])


@shared.lean
def _only(batches: Iterator[pa.RecordBatch], rows: np.ndarray, inside: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(slots.among(rows, batch.column("text_hash").to_numpy()) == inside))


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, n_repeated, kept (the bytes that stay, joined).

    A byte goes if a string of LENGTH bytes covers it that starts at another place of any text, the same text included;
    strings lie within one text and are judged on the input. n_repeated counts the bytes that strings of LEAST bytes cover
    which start elsewhere too; those that no string of LENGTH covers stay. Repeated rows count as texts of their own, so all of each
    goes if it is long enough. Null texts are empty; an empty table gives no rows; other columns are not read.
    """
    shared.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    whole = f"{_ROW}, text string"
    rows = rows.select("doc_id", "text_hash", "text")

    cores = rows.mapInArrow(_cores, "core long").groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    seen = slots.bitmap(cores, "core")
    found = f"{_ROW}, core long, context long, first long, last long"
    contexts = shared.save(rows.mapInArrow(partial(_contexts, seen=seen), found), "repeat-contexts")
    entries = contexts.groupBy("core", "context").agg(F.count(F.lit(1)).alias("times"), F.max(F.col("last") - F.col("first") + 1).alias("n"))
    #: Strings of a core that has several contexts, 1 for any other.
    strings = F.when(F.count(F.lit(1)) > 1, F.sum("n")).otherwise(1).cast("long")
    entries = shared.save(entries.join(entries.groupBy("core").agg(strings.alias("strings")), "core").filter("times > 1 OR strings > 1").drop("n"), "repeat-entries")
    placed = contexts.join(entries, ["core", "context"])
    whole_runs = placed.filter("times > 1").select("doc_id", "text_hash", "first", "last", F.lit(LENGTH).cast("long").alias("length"))

    one = F.struct("doc_id", "text_hash", "first", "last")
    several = placed.filter("times > 1 AND strings > 1").groupBy("core", "context", "strings", "times").agg(F.min(one).alias("one")).select("one.*", "core", "strings", "times")
    stands = placed.filter("times = 1").select("doc_id", "text_hash", "first", "last", "core", "strings", "times").unionByName(several)
    listed = stands.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last", "core", "strings", "times")).alias("runs"))
    listed = shared.save(listed, "repeat-listed")
    likely = rows.mapInArrow(partial(_only, rows=slots.bitmap(listed, "text_hash"), inside=True), whole)
    texts_of = likely.dropDuplicates(["doc_id", "text_hash"]).withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "hash")
    dictionary = listed.join(texts_of, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("doc_id", "text_hash", "text", "runs")
    dictionary = dictionary.mapInArrow(_entries, f"{_ROW}, core long, strings long, times long, first long, last long, context binary")
    dictionary = shared.save(dictionary, "repeat-dictionary")
    by_core = dictionary.filter(F.col("strings") <= OFTEN).repartition("core").sortWithinPartitions("core")
    single = by_core.mapInArrow(_matched, f"{_ROW}, first long, last long, length long")

    strings = dictionary.filter(F.col("strings") > OFTEN).mapInArrow(_strings, f"{_ROW}, k1 long, k2 long, q1 long, q2 long, at long, times long")
    repeated = strings.groupBy("k1", "k2").agg(F.sum("times").alias("all_times")).filter("all_times > 1").select("k1", "k2")
    frequent = shared.save(strings.join(repeated, ["k1", "k2"]).drop("k1", "k2"), "repeat-frequent")
    longer = frequent.filter("q1 IS NOT NULL").groupBy("q1", "q2").agg(F.sum("times").alias("all_times")).filter("all_times > 1").select("q1", "q2")
    alone = frequent.filter("times = 1")
    for length, some in ((LEAST, alone), (LENGTH, alone.join(longer, ["q1", "q2"], "left_semi"))):
        single = single.unionByName(some.select("doc_id", "text_hash", F.col("at").alias("first"), F.col("at").alias("last"), F.lit(length).cast("long").alias("length")))

    spans = whole_runs.unionByName(single).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last", "length")).alias("spans"))
    spans = shared.save(spans, "repeat-spans").withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "hash")
    some = slots.bitmap(spans, "hash")
    touched = rows.mapInArrow(partial(_only, rows=some, inside=True), whole)
    touched = touched.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left").select("doc_id", "text", "spans")
    others = rows.mapInArrow(partial(_only, rows=some, inside=False), whole)
    others = others.select("doc_id", "text", F.lit(None).cast("array<struct<first:bigint,last:bigint,length:bigint>>").alias("spans"))
    return touched.unionByName(others).mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, n_repeated long, kept binary")
