"""Bit tables of 64-bit keys: what is broadcast to pre-filter rows, of bounded size.

A table may say yes to a key that it does not hold, so it only ever saves work.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS_LOG2 = 29  # 64 MB


def bits_for(keys: int, per_key: int = 16) -> int:
    """log2 of a table's bits for so many keys; at the bound more rows pass, none is lost."""
    return min(MOST_BITS_LOG2, max(16, math.ceil(math.log2(max(1, keys) * per_key))))


def bit_table(keys: DataFrame, bits: int) -> np.ndarray:
    """Two bits per row of `keys` (key: a well mixed long) in a table of 2^bits bits."""
    spots = F.explode(F.array(F.col("key").bitwiseAND((1 << bits) - 1), F.shiftrightunsigned("key", 64 - bits)))
    words = (
        keys.select(spots.alias("spot"))
        .groupBy(F.shiftright("spot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("mask"))
    )
    found = words.toArrow()  # Arrow: no object per row on the driver
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return table


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = np.uint64(int(len(table) * 64).bit_length() - 1)

    def has(spot):
        return (table[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) != 0

    return has(keys & np.uint64(len(table) * 64 - 1)) & has(keys >> (np.uint64(64) - bits))
