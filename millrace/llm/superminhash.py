"""SuperMinHash signatures of word-shingle sets."""

from __future__ import annotations

import numpy as np

from millrace.llm.arrays import hashes, lower, mix, words

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of the ``size``-word shingles of each row, in that order.

    A-Z count as a-z. A row of fewer words has its whole sequence as one shingle, a row without words none.
    """
    buf = lower(buf)
    starts, ends, row = words(buf, off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = hashes(buf, starts, ends)
    count = np.bincount(row, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    place = np.arange(len(word)) - first[row]
    left = count[row] - place
    starts_here = (left >= size) | ((place == 0) & (count[row] < size))
    at = np.flatnonzero(starts_here)
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        reach = np.minimum(at + k, len(word) - 1)
        value = np.where(left[at] > k, mix(value * _GOLD + word[reach] + np.uint64(k + 1)), value)
    order = np.lexsort((value, row[at]))
    r, v = row[at][order], value[order]
    new = np.ones(len(v), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return r[new], v[new]


def signatures(row: np.ndarray, value: np.ndarray, n: int, m: int) -> np.ndarray:
    """The n x m SuperMinHash signatures, as 64-bit integers, of sets given as (row, element hash).

    Every element walks its own random permutation of the m slots; at step i it offers i + u, u uniform in [0, 1),
    to the slot it stands on. All elements take step i together, and a row stops once each of its slots holds less
    than i + 1, as later offers can't be smaller: that is the early stop. Slots of empty sets keep the largest integer.
    Offers are held as i in the 8 upper bits and 55 random bits below.
    """
    sig = np.full(n * m, np.iinfo(np.int64).max, np.int64)
    live = np.arange(len(row))
    perm = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(row), m)).copy()
    state = value.copy()
    low = np.uint64((1 << 55) - 1)
    for i in range(m):
        if not len(live):
            break
        state = mix(state + _GOLD)
        k = i + ((state >> np.uint64(32)) % np.uint64(m - i)).astype(np.int64)
        mine = np.arange(len(live))
        slot = perm[mine, k]
        perm[mine, k] = perm[mine, i]
        offer = (mix(state ^ _GOLD) & low).astype(np.int64) | (i << 55)
        np.minimum.at(sig, row[live] * m + slot, offer)
        full = (sig.reshape(n, m) < ((i + 1) << 55)).all(axis=1)
        keep = ~full[row[live]]
        live, state, perm = live[keep], state[keep], perm[keep]
    return sig.reshape(n, m)
