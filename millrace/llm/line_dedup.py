"""Line deduplication within an edit distance of 1, by a join of deletion neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import shared
from millrace.llm.arrays import _power, long, mix

#: Two lines match within one edit for each so many code points of the longer one, one edit at most.
CHARS_PER_EDIT = 16
#: Slots of the table by which lines without a possible partner are passed over: a bound on what is broadcast.
SLOTS = 1 << 18

_ORDER = "struct<no_id:boolean,doc_id:bigint,text_hash:bigint,line:int>"


def _lines(docs: DataFrame) -> DataFrame:
    """place (where the line stands), h1 and h2 (its 128-bit hash), line, for each line that isn't blank."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "text_hash", F.col("at").cast("int").alias("line"))
    return rows.filter(F.col("line").rlike(r"[^\s]")).select(place.alias("place"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line")


def _half_keys(n: Column) -> list[Column]:
    """Keys of which two lines within one edit share one: either half, for a shorter line of n or of n - 1 characters.

    Without the edit both halves of the shorter line stand at the start or at the end of the longer one, and an edit
    touches only one of them. A line one character short of CHARS_PER_EDIT only matches longer ones.
    """
    keys = []
    for short in (n, n - 1):
        half = F.floor(short / 2).cast("int")
        some = F.lit(True) if short is n else n >= CHARS_PER_EDIT
        keys.append(F.when(some, F.xxhash64(F.lit("start"), short, F.substring(F.col("line"), F.lit(1), half))))
        keys.append(F.when(some, F.xxhash64(F.lit("end"), short, F.substring(F.col("line"), n - (short - half) + 1, short - half))))
    return keys


#: Bases of the two rolling hashes of a line's variants, and what tells variants with their place from those without.
_BASES, _PLACED = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25)
#: Variants that are given out at a time.
_OUT = 1 << 16


def _variant_hashes(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a line without each of its characters, and of the whole line at the end, in time of its length.

    Both are sums of characters times powers of a base, so what follows the missing character moves by one power.
    """
    n, halves = len(chars), []
    for base in _BASES:
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((chars + np.uint64(1)) * _power(base, n)[:n], out=total[1:])
        without = total[:-1] + (total[-1] - total[1:]) * np.uint64(pow(base, -1, 1 << 64))
        halves.append(mix(np.append(without, total[-1])))
    return halves[0], halves[1]


@shared.lean
def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each line: itself, itself without one character, and that together with the place of the character.

    ``halves`` has a bit for each of ``_half_keys`` that another line shares; it says where an edit can be.
    """
    for batch in batches:
        out: list[tuple] = []
        held = 0

        def part(out: list[tuple], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
            at, role, k1, k2 = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([batch.column("place").take(pa.array(at)), pa.array(role, pa.int32()), pa.array(long(k1)), pa.array(long(k2))], ["place", "role", "k1", "k2"])

        for i, (line, halves) in enumerate(zip(batch.column("line").to_pylist(), batch.column("halves").to_pylist(), strict=True)):
            chars = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64)
            n, (h1, h2) = len(chars), _variant_hashes(chars)
            spans = [(0, n, n + 1)] if halves & 3 else []
            spans += [(role, first, last) for bit, role, first, last in ((1, 2, n // 2, n), (2, 2, 0, n // 2), (4, 1, (n - 1) // 2, n), (8, 1, 0, (n - 1) // 2 + 1)) if halves & bit and n >= CHARS_PER_EDIT]
            for role, first, last in spans:
                for begin in range(first, last, _OUT):
                    at = np.arange(begin, min(last, begin + _OUT))
                    if role == 1:  # of equal neighbours it doesn't matter which is missing
                        at = at[(at == first) | (chars[at] != chars[np.maximum(at, 1) - 1])]
                    k1, k2 = h1[at], h2[at]
                    if role == 2:
                        k1, k2 = mix(k1 + at.astype(np.uint64) * _PLACED), mix(k2 ^ _PLACED)
                    out.append((np.full(len(at), i), np.full(len(at), role), k1, k2))
                    held += len(at)
                    if held >= _OUT:
                        yield part(out)
                        out, held = [], 0
        if out:
            yield part(out)


def within_one(a: str, b: str) -> bool:
    """Whether one insertion, deletion or substitution at most makes ``a`` of ``b``, in time of their length."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at, past = 0, len(a)
    while at < past:  # the first place where they differ is from ``at`` to ``past``
        mid = (at + past) // 2
        if a[at : mid + 1] == b[at : mid + 1]:
            at = mid + 1
        else:
            past = mid
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


@shared.lean
def _matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("line"), batch.column("mate_line"), strict=True)
        good = [max(len(a), len(b)) >= CHARS_PER_EDIT and within_one(a, b) for a, b in ((x.as_py(), y.as_py()) for x, y in pairs)]
        yield batch.select(["place"]).filter(pa.array(good, pa.bool_()))


def _near(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """place of each first line that comes after a line within one edit of it.

    ``firsts`` (h1, h2, place, n, halves) has one row for each different line. Lines that share no half with another
    are passed over; the texts of the rest are found again by a table of SLOTS slots at most, then by the hash.
    """
    halves = firsts.filter(F.col("n") >= CHARS_PER_EDIT - 1).select("h1", "h2", F.posexplode("halves").alias("bit", "half")).filter("half IS NOT NULL")
    shared_half = halves.groupBy("half").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1").select("half")
    found = halves.join(shared_half, "half").groupBy("h1", "h2").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("halves"))
    found = shared.save(found.join(firsts.select("h1", "h2", "place"), ["h1", "h2"]), "line-candidates")
    slot = F.pmod("h1", F.lit(SLOTS)).alias("slot")
    slots = found.select(slot).distinct()
    likely = _lines(docs).withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi")
    texts = shared.save(likely.join(found, ["h1", "h2", "place"]).select("place", "line", "halves").dropDuplicates(["place"]), "line-texts")

    keyed = texts.mapInArrow(_variants, f"place {_ORDER}, role int, k1 long, k2 long")
    same_key = Window.partitionBy("k1", "k2")

    def least(role: int) -> Column:
        return F.min(F.when(F.col("role") == role, F.col("place"))).over(same_key)

    #: A line matches a longer one by being its variant, and one of its length by the same variant at the same place.
    mate = F.when(F.col("role") == 0, least(1)).when(F.col("role") == 1, least(0)).otherwise(least(2))
    pairs = keyed.withColumn("mate", mate).filter(F.col("mate") < F.col("place")).select("place", "mate").distinct()
    mine, other = texts.select("place", "line"), texts.select(F.col("place").alias("mate"), F.col("line").alias("mate_line"))
    checked = pairs.join(mine, "place").join(other, "mate").select("place", "line", "mate_line").mapInArrow(_matching, f"place {_ORDER}")
    return checked.distinct()


@shared.lean
def _kept_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_removed, kept = [], [], []
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
            lines, stay = text.split("\n"), set(places or ())
            left = [x for i, x in enumerate(lines) if i in stay or not x.strip(" \t\n\x0b\x0c\r")]
            n_lines.append(len(lines))
            n_removed.append(len(lines) - len(left))
            kept.append("\n".join(left))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_removed", "kept"])


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept (the text of the lines that stay).

    Lines end at line feeds. A line goes if an earlier line equals it or is within one insertion, deletion or
    substitution of a code point and the longer of both has CHARS_PER_EDIT code points; earlier is by doc_id (null last), then by a hash of the text,
    then by place, and a line that goes itself still counts as earlier. Time grows with the length of a line. Lines of blanks only stay and match nothing.
    Rows equal in doc_id and text are one document. Null texts are empty texts; an empty table gives no rows; other
    columns are not read.
    """
    shared.small_batches(docs.sparkSession)
    n = F.char_length("line")
    halves = F.when(n >= CHARS_PER_EDIT - 1, F.array(*_half_keys(n)))
    keyed = _lines(docs).select("h1", "h2", "place", F.struct("place", n.alias("n"), halves.alias("halves")).alias("s"))
    firsts = shared.save(keyed.groupBy("h1", "h2").agg(F.min("s").alias("s")).select("h1", "h2", "s.place", "s.n", "s.halves"), "line-firsts")
    stay = firsts.select("place").join(_near(firsts, docs), "place", "left_anti")
    by_row = stay.groupBy("place.no_id", "place.doc_id", "place.text_hash").agg(F.collect_list("place.line").alias("places"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("__doc_id"), text.alias("text"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    joined = rows.join(by_row, ["no_id", "doc_id", "text_hash"], "left").select(F.col("__doc_id").alias("doc_id"), "text", "places")
    return joined.mapInArrow(_kept_lines, "doc_id long, n_lines long, n_removed long, kept string")
