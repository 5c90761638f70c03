"""Near-duplicate documents: SuperMinHash, banding, confirmation on full shingle sets, union of the links."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import shared
from millrace.llm.arrays import long, mix, steps, texts
from millrace.llm.components import components
from millrace.llm.superminhash import shingles, signatures

#: Bands of slots: a pair at similarity 0.85 shares no band with a probability below 2e-8.
BANDS, BAND_SLOTS = 24, 4

#: Members of a candidate group that one task compares with one another, at most about twice that many, and their shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20

#: What tells the two halves of a set's digest apart.
SALTS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)

#: Columns of the incidence matrix held at a time.
COLUMNS = 4096


def _set_digest(row: np.ndarray, value: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A 64-bit digest of each row's set: the mixed sum of its mixed elements and its size."""
    total = np.zeros(n, np.uint64)
    np.add.at(total, row, mix(value ^ np.uint64(salt)))
    return mix(total + np.bincount(row, minlength=n).astype(np.uint64))


@shared.lean
def _prints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = texts(batch.column("text"))
        for a, b in steps(off):
            row, value = shingles(buf[off[a] : off[b]], off[a : b + 1] - off[a], words)
            n = np.bincount(row, minlength=b - a)
            sig = signatures(row, value, b - a, BANDS * BAND_SLOTS).view(np.uint64).reshape(b - a, BANDS, BAND_SLOTS)
            bands = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (b - a, BANDS)).copy()
            for k in range(BAND_SLOTS):
                bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
            bands[n == 0] = 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(long(bands.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("text_hash").slice(a, b - a), pa.array(n, pa.int64()), *(pa.array(long(_set_digest(row, value, b - a, salt))) for salt in SALTS), lists], ["doc_id", "text_hash", "n_shingles", "node", "other", "bands"])


def _links(group: pa.Table, words: int, percent: int) -> pa.Table:
    """Edges (a, b) of a spanning forest of the links among the group's documents; b is the group's hub, if it has one,
    for all documents that its links reach."""
    group = group.combine_chunks().sort_by([("hub", "descending"), ("node", "ascending")])
    node = group.column("node").to_numpy()
    buf, off = texts(group.column("text").combine_chunks() if isinstance(group.column("text"), pa.ChunkedArray) else group.column("text"))
    parts = [(r + a, v) for a, b in steps(off) for r, v in [shingles(buf[off[a] : off[b]], off[a : b + 1] - off[a], words)]]
    row, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    _, first = np.unique(node, return_index=True)  # a repeated doc_id may bring a class twice
    once = np.zeros(len(node), bool)
    once[first] = True
    row, value = row[once[row]], value[once[row]]
    size = np.bincount(row, minlength=len(node))
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    element = np.cumsum(new) - 1
    shared_by_two = np.bincount(element)[element] > 1
    row, element = row[shared_by_two], element[shared_by_two]
    common = np.zeros((len(node), len(node)), np.float32)
    if len(element):
        _, element = np.unique(element, return_inverse=True)
        cuts = np.searchsorted(element, np.arange(0, element[-1] + COLUMNS + 1, COLUMNS))
        for c in range(len(cuts) - 1):
            at = slice(cuts[c], cuts[c + 1])
            held = np.zeros((len(node), COLUMNS), np.float32)
            held[row[at], element[at] - c * COLUMNS] = 1
            common += held @ held.T
    linked = (100 * common.astype(np.int64) >= percent * (size[:, None] + size[None, :] - common.astype(np.int64))) & (size[:, None] > 0) & (size[None, :] > 0)
    root = np.arange(len(node))
    todo = once.copy()
    for i in np.flatnonzero(once):  # the hub is the first row
        if not todo[i]:
            continue
        todo[i] = False
        wave = np.array([i])
        while len(wave):
            near = np.flatnonzero(linked[wave].any(axis=0) & todo)
            todo[near], root[near], wave = False, i, near
    far = np.flatnonzero(root != np.arange(len(node)))
    return pa.table({"a": node[far], "b": node[root[far]]})


def _blocks(size: Column, shingles_in: Column) -> Column:
    return F.greatest(F.ceil(size / F.lit(BLOCK)), F.ceil(shingles_in / F.lit(BLOCK_SHINGLES))).cast("long")


def _large_links(large: DataFrame, banded: DataFrame, linked: Callable[..., DataFrame]) -> DataFrame:
    """Edges of candidate groups of several blocks.

    First each block is compared with the group's hub, the class that shares most bands: in a group of copies of one
    text nearly all link to it. Only the classes that don't are then compared with the whole group, block by block.
    """
    mine = banded.join(large.select("node").distinct(), "node", "left_semi").distinct()
    common = mine.join(mine.groupBy("band").agg(F.count(F.lit(1)).alias("n")), "band").groupBy("node").agg(F.sum("n").alias("n"))
    hubs = large.join(common, "node").groupBy("root").agg(F.max(F.struct("n", "node"))["node"].alias("hub_node"))
    marked = large.join(hubs, "root").withColumn("hub", F.col("node") == F.col("hub_node"))
    everywhere = marked.filter("hub").select("node", "text", "hub", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    by_hub = shared.save(linked(marked.filter("NOT hub").select("node", "text", "hub", "root", "block").unionByName(everywhere), "root", "block"), "near-hub-links")

    settled = by_hub.join(hubs, F.col("b") == F.col("hub_node"), "left_semi").select(F.col("a").alias("node"))
    open_ = shared.save(marked.filter("NOT hub").join(settled, "node", "left_anti").select("node", "text", "root", "blocks", "n_shingles"), "near-open")
    parts = open_.groupBy("root").agg(_blocks(F.count(F.lit(1)), F.sum("n_shingles")).alias("parts"))
    apart = F.lit(False).alias("hub")
    some = open_.join(parts, "root").select("node", "text", apart, "root", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    all_ = large.join(parts, "root").select("node", "text", apart, "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "block")
    return by_hub.unionByName(linked(some.unionByName(all_), "root", "part", "block"))


def _text(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _row_key() -> list[Column]:
    """What finds a text again: its doc_id, null apart from all numbers, and the text's hash."""
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("text_hash")]


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents link when 100 * |A and B| >= percent * |A or B| over their distinct ``words``-word shingles (A-Z as a-z).
    Equal sets are one class, known by a 128-bit digest. Classes that share a band form candidate groups, and inside a
    group classes are compared on full sets: a group over BLOCK classes first block by block with its hub, then those
    that the hub doesn't reach with all, each pair of blocks in a task of its own; tasks return a spanning forest of the
    links, not the pairs. component_id is the least doc_id
    reachable. Texts without words link with nothing. Rows that repeat a doc_id with an equal text share a verdict, with
    another text each has its own; a row without doc_id links like any other, and its kept is false if the component has
    a doc_id. An empty table gives no rows; other columns are not read.
    """
    return _verdicts(docs, words, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _verdicts(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``near_duplicates`` with the hash of each row's text and a key of its component, null for texts without words."""
    shared.small_batches(docs.sparkSession)
    prints = shared.save(_text(docs).mapInArrow(partial(_prints, words=words), "doc_id long, text_hash long, n_shingles long, node long, other long, bands array<long>"), "near-prints")
    some = prints.filter("n_shingles > 0")

    def in_classes(rows: DataFrame) -> DataFrame:
        return rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.min(F.struct(*_row_key())).alias("row"), F.max("n_shingles").alias("n_shingles"), F.min("other").alias("least"), F.max("other").alias("most"))

    classes = shared.save(in_classes(some), "near-classes")
    clash = classes.filter("least <> most").select("node", F.lit(True).alias("clash"))
    if not clash.isEmpty():  # different sets with one first half: both halves make their node
        apart = F.when(F.col("clash"), F.xxhash64("node", "other")).otherwise(F.col("node"))
        some = shared.save(some.join(clash, "node", "left").withColumn("node", apart).drop("clash"), "near-apart")
        classes = shared.save(in_classes(some), "near-classes")
    banded = some.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub <> top")
    stars = banded.join(buckets, "band").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    stars = components(stars, "near-candidates")

    groups = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()).join(classes.select("node", "row", "n_shingles"), "node")
    blocks = groups.groupBy("root").agg(_blocks(F.count(F.lit(1)), F.sum("n_shingles")).alias("blocks"))
    members = groups.join(blocks, "root").select("row.*", "node", "root", "n_shingles", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    columns = ["node", "root", "text", "n_shingles", "blocks", "block"]
    found = _text(docs).select("text", *_row_key()).join(members, ["no_id", "id", "text_hash"])
    without_id = found.filter("no_id").select(*columns).dropDuplicates(["node", "block"])  # equal texts may be many
    members = shared.save(found.filter("NOT no_id").select(*columns).unionByName(without_id), "near-members")

    def forest(group: pa.Table) -> pa.Table:
        return _links(group, words, percent)

    def linked(rows: DataFrame, *by: str) -> DataFrame:
        # Dealt by all of ``by``: what a join has dealt by the root alone would leave all blocks of a group in one task.
        return rows.select("node", "text", "hub", *by).repartition(*by).groupBy(*by).applyInArrow(forest, "a long, b long")

    links = linked(members.filter("blocks = 1").withColumn("hub", F.lit(False)), "root")
    large = members.filter("blocks > 1")
    if not large.isEmpty():
        links = links.unionByName(_large_links(large, banded, linked))
    merged = components(links, "near-links")

    roots = classes.join(merged, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    found = roots.join(lows, "root").select("node", "component_id", "root")
    alone = prints.filter("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    result = some.join(found, "node").select("doc_id", "text_hash", "n_shingles", "component_id", "root").unionByName(alone)
    return result.withColumn("kept", F.coalesce(F.col("doc_id").eqNullSafe(F.col("component_id")), F.lit(False)))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stands for each group: that of its least doc_id and, if that has
    several texts in the group or no row has a doc_id, of the least hash of the text. Rows equal in doc_id and text count
    once; texts without words stand for themselves.
    """
    kept = _verdicts(docs, words, percent).filter("kept").select("root", F.struct(*_row_key()).alias("row"))
    picked = kept.filter("root IS NOT NULL").groupBy("root").agg(F.min("row").alias("row")).select("row")
    picked = picked.unionByName(kept.filter("root IS NULL").select("row")).select(F.col("row").alias("__key")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    key = F.struct(id_.isNull().alias("no_id"), F.coalesce(id_, F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("text_hash"))
    rows = docs.withColumn("__key", key).join(picked, "__key", "left_semi")
    one = Window.partitionBy("__key").orderBy("__key")
    return rows.withColumn("__turn", F.row_number().over(one)).filter("__turn = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
