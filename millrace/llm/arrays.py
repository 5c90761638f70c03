"""Numpy views of Arrow text columns, shared by the operators that work on bytes and words inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy step handles; a longer single text is a step of its own.
STEP_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n, STEP_BYTES) + 2, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * STEP_BYTES:
            _powers[base] = have
    return have[: n + 1]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def steps(off: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (first, past the last) of at most ``most`` bytes, or of one row."""
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[buf]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes other than 0x20 and 0x09-0x0D; runs end with their row."""
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    is_word = ~_SPACE[buf]
    inner = off[(off > 0) & (off < len(buf))]
    before = np.zeros(len(buf), bool)
    before[1:] = is_word[:-1]
    before[inner] = False
    after = np.zeros(len(buf), bool)
    after[:-1] = is_word[1:]
    after[inner - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same wherever the range lies."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(buf))[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(buf))[starts] + (ends - starts).astype(np.uint64))


def long(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's signed longs."""
    return x.view(np.int64)
