"""A bitmap of fixed size of the keys of a table: what may be broadcast however large the table is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: 4 MB, whatever the number of keys. With more keys more rows pass, none is lost.
BITS = 1 << 25


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Words of 32 bits; the bit of each key in the long ``column`` is set. At most BITS / 32 rows reach the driver."""
    slot = F.pmod(F.col(column), F.lit(BITS))
    words = keys.select(F.shiftright(slot, 5).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(`{column}`, 32) as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 32, np.uint32)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return out


def among(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of the signed 64-bit ``keys`` may be in the table: never false for one that is."""
    slot = keys & (BITS - 1)
    return (words[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1
