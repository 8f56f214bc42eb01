"""Quality rules from suffix-array repetition, one Arrow pass over whole texts.

Within each document the suffixes of its word sequence are sorted by prefix
doubling (numpy, all documents of a chunk together). Longest common prefixes of
neighbours in that order give, for every position, the longest passage that occurs
elsewhere in the document: the maximal repeated substrings. Their spans are united. Beside
the base rule (repeats of eight words), the share that all repeats cover and the longest
repeat are limited: a text of one phrase of five words, over and over, and a text with a
paragraph pasted twice both pass the base rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillrank.llm.arrays import SPACE, frugal, owners, text_chunks, word_bounds
from quillrank.llm.shared import small_batches, table

MIN_WORDS = 20
REPEAT_WORDS = 8
MOST_REPEATED = 30  # percent of words inside repeats of REPEAT_WORDS words and more (base rule)
SHORT_WORDS = 3
MOST_COVERED = 50  # percent of words inside the union of all maximal repeats of SHORT_WORDS words and more
LONG_WORDS = 50
MOST_LONGEST = 5  # percent of words in the longest repeat, if that has LONG_WORDS words and more

RULES_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact integer codes of the words of a chunk, and each document's first word."""
    starts, ends, first = word_bounds(data, offsets)
    packed = data[~SPACE[data]]
    bounds = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), first


def suffix_order(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array over all documents (suffixes end with their document) and the ranks per doubling."""
    n = len(codes)
    doc = owners(first)
    end = first[1:][doc]
    key = doc * (codes.max() + 1) + codes
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.ones(n, dtype=bool)
    head[1:] = key[1:] != key[:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels = [rank]
    tied = ~head
    tied[:-1] |= ~head[1:]
    slots = np.flatnonzero(tied)  # places in `order` that are not settled yet
    step = 1
    while len(slots):
        items = order[slots]
        ahead = items + step
        following = np.where(ahead < end[items], rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((following, rank[items]))
        items, following = items[by], following[by]
        before = rank[items]
        head = np.ones(len(items), dtype=bool)
        head[1:] = (before[1:] != before[:-1]) | (following[1:] != following[:-1])
        order[slots] = items
        rank = rank.copy()
        rank[items] = np.maximum.accumulate(np.where(head, slots, 0))
        levels.append(rank)
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = slots[tied]
        step *= 2
    return order, levels


def longest_elsewhere(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest passage from it that also starts elsewhere in its document."""
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    order, levels = suffix_order(codes, first)
    a, b = order[:-1], order[1:]
    doc = owners(first)
    end = first[1:][doc]
    same = np.flatnonzero(levels[0][a] == levels[0][b])  # at least one common word, so one document
    a, b = a[same], b[same]
    common = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        inside = (i < end[a]) & (j < end[b])
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        equal = inside & (levels[k][i] == levels[k][j])
        # equal ranks mean equal prefixes of 2^k words, or two whole suffixes, which cannot both end there
        common += np.where(equal, 1 << k, 0)
    best = np.zeros(n, dtype=np.int64)
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def covered(first: np.ndarray, length: np.ndarray, least: int) -> np.ndarray:
    """Words per document inside the union of the spans [i, i + length[i]) with length >= least."""
    n = len(length)
    reach = np.where(length >= least, np.arange(n) + length, 0)
    inside = np.maximum.accumulate(reach) > np.arange(n) if n else np.zeros(0, dtype=bool)
    total = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(inside, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_lines(data: bytes, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    for d in range(len(out)):
        seen: set[bytes] = set()
        lines = data[offsets[d] : offsets[d + 1]].split(b"\n")
        if len(lines) > 1:
            for line in lines:
                if line in seen:
                    out[d] += 1
                elif line.strip(b" \t\n\x0b\x0c\r"):
                    seen.add(line)
    return out


def longest_per_document(best: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, dtype=np.int64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.maximum.reduceat(best, first[:-1][some])
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    codes, first = word_codes(data, offsets)
    best = longest_elsewhere(codes, first)
    n_words = np.diff(first)
    repeat = covered(first, best, REPEAT_WORDS)
    longest = longest_per_document(best, first)
    union = covered(first, best, SHORT_WORDS)
    failed = (n_words < MIN_WORDS) | (100 * repeat > MOST_REPEATED * n_words)
    long = (longest >= LONG_WORDS) & (100 * longest > MOST_LONGEST * n_words)
    return {
        "n_words": n_words,
        "word_chars": per_document(~SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_document(_SYMBOL[data], offsets),
        "n_dup_lines": repeated_lines(data.tobytes(), offsets),
        "n_repeat_words": repeat,
        "n_covered_words": union,
        "longest_repeat": longest,
        "base_failed": failed,
        "kept": ~(failed | long | (100 * union > MOST_COVERED * n_words)),
    }


def quality(docs: DataFrame) -> DataFrame:
    """`docs` with the rule columns of RULES_SCHEMA; columns of these names are replaced.

    A null or empty text has no words and fails the base rule. Rows are judged one by
    one, so repeated rows get equal verdicts; a text of any length is judged whole; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    names = [part.split()[0] for part in RULES_SCHEMA.split(", ")]
    base = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, offsets, data in text_chunks(batch):
                found = measure(data, offsets)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[n]) for n in names)], names=[*part.schema.names, *names])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(frugal(run), f"{fields}, {RULES_SCHEMA}")


def passing(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that quality() keeps, with their own columns whatever their names."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, offsets, data in text_chunks(batch):
                yield part.filter(pa.array(measure(data, offsets)["kept"]))

    return docs.mapInArrow(frugal(run), docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
