"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the others by a heap over linked bytes."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import shared

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15

#: Bytes of the pre-tokens of one generation of a worker's memory, which holds two; about what an entry takes besides.
REMEMBERED, ENTRY = 64 << 20, 200


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64, blank, rank, by line), by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """A minimal perfect hash of ``keys``: n keys on n slots, by one displacement for each small bucket of keys.

    Keys that aren't among ``keys`` also land on a slot, so ``find`` compares the bytes there.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4) -> None:
        n = len(keys)
        self.n, self.buckets = n, max(1, -(-n // per_bucket))
        hashed = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        bucket = (hashed % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(n, bool)
        shift = np.zeros(self.buckets, np.uint64)
        slot_key = np.zeros(n, np.int64)
        for b in np.argsort(edges[:-1] - edges[1:], kind="stable"):
            members = order[edges[b] : edges[b + 1]]
            if not len(members):
                break
            tries, first = 64, 0
            while True:
                d = np.arange(first, first + tries, dtype=np.uint64)
                at = self._slots(hashed[members][None, :], d[:, None])
                good = free[at].all(axis=1)
                if len(members) > 1:
                    good &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
                if good.any():
                    pick = int(np.argmax(good))
                    break
                first, tries = first + tries, min(tries * 2, 1 << 16)
            free[at[pick]] = False
            shift[b], slot_key[at[pick]] = d[pick], members
        self.shift, self.slot_key = shift.tolist(), slot_key.tolist()
        self.slots = [keys[k] for k in self.slot_key]

    def _slots(self, hashed: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (hashed ^ (d * np.uint64(_STEP))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64)

    def find(self, key: bytes) -> int | None:
        """The number of ``key`` among the keys, or None."""
        h = xxhash.xxh3_64_intdigest(key)
        x = ((h ^ ((self.shift[h % self.buckets] * _STEP) & _MASK)) * 0xBF58476D1CE4E5B9) & _MASK
        slot = (x ^ (x >> 32)) % self.n
        return self.slot_key[slot] if self.slots[slot] == key else None


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Token ids of ``piece``: the adjacent pair of lowest rank, leftmost first, is joined until no pair has a rank.

    Parts form a linked list; a heap holds (rank, start, end) of joinable pairs, and an entry whose pair no longer
    stands is passed over.
    """
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = after[i]
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := rank.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := rank.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    ids, i = [], 0
    while i < n:
        ids.append(rank[piece[i : end[i]]])
        i = after[i]
    return ids


class Encoder(dict):
    """Pre-token to packed ids, found on first use.

    Once a generation is full it becomes the old one, from which what is used again moves to the new one.
    """

    def __init__(self, tokens: list[bytes], whole: PerfectHash) -> None:
        self.whole = whole
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.old: dict[str, bytes] = {}
        self.bytes = 0

    def __missing__(self, pre_token: str) -> bytes:
        packed = self.old.get(pre_token)
        if packed is None:
            raw = pre_token.encode()
            one = self.whole.find(raw)
            packed = np.array([one] if one is not None else merge(raw, self.rank), "<u4").tobytes()
        self.bytes += ENTRY + len(pre_token) + len(packed)
        if self.bytes > REMEMBERED:
            self.old, self.bytes = dict(self), 0
            self.clear()
        else:
            self[pre_token] = packed
        return packed


_ready: dict[int, Encoder] = {}


def _encoder(vocabulary: Broadcast) -> Encoder:
    if vocabulary.value["key"] not in _ready:
        _ready.clear()
        _ready[vocabulary.value["key"]] = Encoder(vocabulary.value["tokens"], vocabulary.value["whole"])
    return _ready[vocabulary.value["key"]]


def _ids(texts: pa.Array, ids: Encoder, pattern: regex.Pattern) -> list[bytes]:
    return [b"".join(map(ids.__getitem__, pattern.findall(text.as_py() or ""))) for text in texts]


def _bytes(ids: list[bytes], tokens: list[bytes]) -> list[bytes]:
    return [b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]


@shared.lean
def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Broadcast, pattern: str, decoded: bool = False) -> Iterator[pa.RecordBatch]:
    ids, split = _encoder(vocabulary), regex.compile(pattern)
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            packed = _ids(part.column("text"), ids, split)
            columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in packed], pa.int64()), "ids": pa.array(packed, pa.binary())}
            if decoded:
                columns["decoded"] = pa.array(_bytes(packed, vocabulary.value["tokens"]), pa.binary())
            yield pa.RecordBatch.from_pydict(columns)


@shared.lean
def _decode(batches: Iterator[pa.RecordBatch], vocabulary: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _bytes([x.as_buffer().to_pybytes() for x in batch.column("ids")], vocabulary.value["tokens"])
        rest = [n for n in batch.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(texts, pa.binary())], [*rest, "decoded"])


def load(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary for tasks: its tokens by rank and their perfect hash. Its size is that of the rank file."""
    tokens = read_ranks(path)
    return spark.sparkContext.broadcast({"key": hash(tuple(tokens)), "tokens": tokens, "whole": PerfectHash(tokens)})


def encode(docs: DataFrame, vocabulary: Broadcast, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each row's text, row by row, no shuffle;
    if wanted also decoded, the bytes that the ids stand for, found in the same pass.

    Each match of ``pattern`` is encoded on its own; text that is a special token elsewhere is ordinary text here. A
    null or empty text has no ids; repeated rows give repeated rows; empty tables give none; other columns aren't read.
    """
    shared.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded
    return rows.mapInArrow(partial(_encode, vocabulary=vocabulary, pattern=pattern, decoded=decoded), schema)


def decode(encoded: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """``encoded`` with the column ids replaced by decoded, the bytes that the ids stand for. ids must not be null."""
    kept = [f for f in encoded.schema.fields if f.name != "ids"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "decoded binary"])
    return encoded.mapInArrow(partial(_decode, vocabulary=vocabulary), schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    coded = encode(docs, load(docs.sparkSession, path), pattern, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
