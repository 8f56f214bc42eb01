"""How often hashes occur over a whole corpus, in a few levels: counted in Spark, kept as bits.

Hashes are dealt by their leading bits to ranges. A task packs what it has seen into one
sorted binary per range, so the shuffle carries four bytes for a hash and no row of its
own. Each range is counted by itself and gives slices of bit tables, one table for each
level; their total size is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEVELS = (2, 16, 128)  # occurrences
FLUSH = 1 << 20  # hashes that a task packs at a time
_RANGE_KEYS = 1 << 18
_SLICE_LOG2 = 17
MOST_TABLE_LOG2 = 29  # 64 MB


@dataclass(frozen=True)
class Layout:
    """Ranges by leading bits, and log2 of the bits of a range's slice in the lowest level's table."""

    ranges_log2: int
    slice_log2: int

    @staticmethod
    def of(hashes: int) -> Layout:
        """For about so many hashes in all: a range holds a few hundred thousand of them, however many there are."""
        ranges = min(20, max(0, math.ceil(math.log2(max(1, hashes) / _RANGE_KEYS))))
        return Layout(ranges, min(_SLICE_LOG2, MOST_TABLE_LOG2 - ranges))

    def split(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(range, the 32 bits that follow) of each hash."""
        following = (hashes >> np.uint64(32 - self.ranges_log2)).astype(np.uint32)
        return (hashes >> np.uint64(64 - self.ranges_log2) if self.ranges_log2 else np.zeros(len(hashes), np.uint64)).astype(np.int64), following

    def spots(self, following: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Two bits of a slice for each hash."""
        size = self.level_log2(level)
        return (following & np.uint32((1 << size) - 1)).astype(np.int64), (following >> np.uint32(32 - size)).astype(np.int64)

    def level_log2(self, level: int) -> int:
        return max(3, self.slice_log2 - 3 * level)


class Frequency:
    """The tables; occurrences() is the number of LEVELS that a hash reaches (or seems to: tables can overstate)."""

    def __init__(self, layout: Layout, tables: list[np.ndarray]):
        self.layout, self.tables = layout, tables

    def occurrences(self, hashes: np.ndarray) -> np.ndarray:
        part, following = self.layout.split(hashes)
        out = np.zeros(len(hashes), dtype=np.int64)
        live = np.arange(len(hashes))
        for level, table in enumerate(self.tables):
            base = part[live] << self.layout.level_log2(level)
            found = np.ones(len(live), dtype=bool)
            for spot in self.layout.spots(following[live], level):
                at = base + spot
                found &= (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0
            live = live[found]
            out[live] += 1
        return out


def packed(hashes: np.ndarray, layout: Layout, most: int) -> pa.RecordBatch:
    """range, hashes: a row for each range seen; a hash comes as often as seen here, `most` times at most."""
    value = np.sort(hashes >> np.uint64(32 - layout.ranges_log2))
    new = np.ones(len(value), dtype=bool)
    new[1:] = value[1:] != value[:-1]
    at = np.arange(len(value))
    value = value[at - np.maximum.accumulate(np.where(new, at, 0)) < most]
    part = (value >> np.uint64(32)).astype(np.int32)
    begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    offsets = np.append(begin, len(part)).astype(np.int32) * 4
    data = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(value.astype(np.uint32))])
    return pa.RecordBatch.from_arrays([pa.array(part[begin]), data], names=["range", "hashes"])


def counted(chunks: Iterator[np.ndarray], layout: Layout, most: int = LEVELS[-1]) -> Iterator[pa.RecordBatch]:
    """Packs hashes from an iterator of arrays, FLUSH at a time."""
    held, size = [], 0
    for hashes in chunks:
        held.append(hashes)
        size += len(hashes)
        if size >= FLUSH:
            yield packed(np.concatenate(held), layout, most)
            held, size = [], 0
    if size:
        yield packed(np.concatenate(held), layout, most)


def frequency(packs: DataFrame, layout: Layout, levels: tuple[int, ...] = LEVELS) -> Frequency:
    """Counts rows of packed(); only the tables' slices reach the driver."""

    def count(table: pa.Table) -> pa.Table:
        found = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in table["hashes"]]))
        begin = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        times, found = np.diff(np.append(begin, len(found))), found[begin]
        slices = []
        for level, least in enumerate(levels):
            bits = np.zeros(1 << layout.level_log2(level), dtype=bool)
            for spot in layout.spots(found[times >= least], level):
                bits[spot] = True
            slices.append(np.packbits(bits, bitorder="little").tobytes())
        return pa.table([table["range"][:1], *([s] for s in slices)], names=["range", *(f"level{i}" for i in range(len(levels)))])

    fields = ", ".join(f"level{i} binary" for i in range(len(levels)))
    found = packs.groupBy("range").applyInArrow(count, f"range int, {fields}").toArrow()
    tables = []
    for level in range(len(levels)):
        size = 1 << (layout.level_log2(level) - 3)
        whole = np.zeros((1 << layout.ranges_log2) * size, dtype=np.uint8)
        for part, data in zip(found["range"].to_pylist(), found[f"level{level}"], strict=True):
            whole[part * size : (part + 1) * size] = np.frombuffer(data.as_buffer(), dtype=np.uint8)
        tables.append(whole)
    return Frequency(layout, tables)
