"""Array helpers that run inside Arrow tasks: tokens, hashes and slices of whole texts.

Every function works on one chunk of documents at a time. A chunk holds about a
megabyte of text (or one longer document), so memory stays bounded while the work
is done by numpy over all documents of the chunk at once.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

#: The six bytes that end a word: space and 09-0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)

_PLACE_BITS = 24


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, giving freed memory back to the machine at the end of a task: workers outlive it, idle ones too."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ordered(hashes: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Numbers that order places by their hash (40 bits of it), then place, and the way back to places.

    The order of two places never depends on the length of the array, so equal texts choose
    equal places wherever they are cut.
    """
    at = np.arange(len(hashes))
    bits = np.uint64(_PLACE_BITS)
    if len(hashes) <= 1 << _PLACE_BITS:
        return (hashes >> bits << bits) | at.astype(np.uint64), lambda x: (x & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    by = np.lexsort((at, hashes >> bits))
    rank = np.empty(len(hashes), dtype=np.uint64)
    rank[by] = at.astype(np.uint64)
    return rank, lambda x: by[x.astype(np.int64)]


class Spans:
    """Hashes of spans of tokens, from hashes of all spans of 1, 2, 4, ... tokens.

    A span is hashed by the two (overlapping) spans of a power of two that cover it, and
    its length. With `octets` the tokens are bytes, and spans up to 8 are the bytes themselves.
    """

    def __init__(self, tokens: np.ndarray, octets: bool = False):
        self.levels, self.octets = [tokens], octets

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            left, right = last[:-step], last[step:]
            if self.octets and step < 8:
                self.levels.append(left | (right << np.uint64(8 * step)))
            else:
                self.levels.append(mix(left * _BASE + right))
        return self.levels[k]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - start
        power = np.log2(np.maximum(length, 1)).astype(np.int64)
        out = np.zeros(len(start), dtype=np.uint64)
        for k in np.unique(power):
            here = np.flatnonzero(power == k)
            level = self.level(int(k))
            out[here] = mix(level[start[here]] * _BASE + mix(level[end[here] - (1 << int(k))] + length[here].astype(np.uint64)))
        return out


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their text as (offsets, bytes); null texts are empty."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + texts.offset + 1)[texts.offset :]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, len(texts))
        yield batch.slice(row, end - row), offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the index of each document's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_PLACES = 32
_AT = mix(np.arange(_PLACES * 256, dtype=np.uint64) + np.uint64(0xA24BAED4963EE407))


def word_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, and the index of each document's first word.

    The sum over a word's bytes of a random value for (place in the word, byte): unlike a
    polynomial modulo 2^64 it has no words of a pattern that collide.
    """
    starts, ends, first = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    length = ends - starts
    at = np.flatnonzero(~SPACE[data])
    code = at - np.repeat(starts, length)
    code <<= 8
    code |= data[at]
    value = _AT[np.minimum(code, len(_AT) - 1)]
    far = np.flatnonzero(code >= len(_AT))
    value[far] = mix(code[far].astype(np.uint64) + np.uint64(0xA24BAED4963EE407))
    sums = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(value, out=sums[1:])
    until = np.cumsum(length)
    return mix(sums[until] - sums[until - length] + length.astype(np.uint64)), first


def owners(first: np.ndarray) -> np.ndarray:
    """The document index of every token."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(tokens: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct word shingles of each document, sorted.

    A document of fewer words than `size` has its whole sequence as one shingle;
    a document without words has none.
    """
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][doc]
    hashes = mix(np.minimum(count, size).astype(np.uint64))[doc]
    end = first[1:][doc]
    for step in range(size):
        inside = start + step < end
        following = tokens[np.minimum(start + step, len(tokens) - 1)] if len(tokens) else hashes
        hashes = np.where(inside, mix(hashes * _BASE + following), hashes)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[keep], hashes[keep]
