"""Substring dedup by recompression of word sequences, in Spark rounds.

A round names maximal runs of one symbol, then pairs of neighbours whose hashes fall on
the left and the right side. A name is a hash of what it stands for, so the same run or
pair has the same name in every task. A name also depends on its neighbours (they could
have paired with it); each symbol carries the range of words that decided it. Equal word
sequences therefore share every symbol whose range lies inside them.

Each round is a Spark job over the whole corpus: it counts the symbols of its level with
the words that decided them. A symbol that occurs once cannot lie in a repeat: it is dead,
the next round names nothing that holds it, and no window around it is looked at again.
What the last round leaves are high-level symbols that documents share. Within each window
the one of smallest hash is the anchor under which repeats.py verifies window by window; a
window without a symbol stands for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.arrays import SPACE, Spans, frugal, mix, ordered, owners, text_chunks, word_bounds, word_tokens
from quillrank.llm.frequency import Frequency, Layout, counted, frequency
from quillrank.llm.repeats import CHUNK, LOOK, Groups, Method, Places, covered_tokens, cut_by_spans, find_repeats, first_of_groups, numbered, pieces
from quillrank.llm.shared import small_batches, table, unused

WINDOW = 20
ROUNDS = 2

_STEP = np.uint64(0xD6E8FEB86659FD93)


def runs(name, start, end, low, high, doc):
    """Name maximal runs; each symbol now depends on both neighbours."""
    n = len(name)
    head = np.ones(n, dtype=bool)
    head[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    a = np.flatnonzero(head)
    b = np.append(a[1:], n) - 1
    length = (b - a + 1).astype(np.uint64)
    named = np.where(length > 1, mix(name[a] * _STEP + length), name[a])
    left = (a > 0) & (doc[np.maximum(a - 1, 0)] == doc[a])
    right = (b < n - 1) & (doc[np.minimum(b + 1, n - 1)] == doc[a])
    low = np.where(left, np.minimum(low[a], low[np.maximum(a - 1, 0)]), start[a] - 1)
    high = np.where(right, np.maximum(high[b], high[np.minimum(b + 1, n - 1)]), end[b] + 1)
    return named, start[a], end[b], low, high, doc[a]


def pairs(name, start, end, low, high, doc, salt: int):
    """Name neighbours (left side, right side); what stays single depends on the neighbour that did not join."""
    n = len(name)
    right_side = (mix(name + np.uint64(salt)) >> np.uint64(63)).astype(bool)
    near = np.zeros(n, dtype=bool)  # the next symbol is of the same document
    near[:-1] = doc[1:] == doc[:-1]
    joins = near.copy()
    joins[:-1] &= ~right_side[:-1] & right_side[1:]
    taken = np.zeros(n, dtype=bool)
    taken[1:] = joins[:-1]
    a = np.flatnonzero(~taken)
    pair = joins[a]
    b = a + pair
    after, before = np.minimum(a + 1, n - 1), np.maximum(a - 1, 0)
    has_before = (a > 0) & near[before]
    named = np.where(pair, mix(name[a] * _STEP + mix(name[b])), name[a])
    low_single = np.where(right_side[a], np.where(has_before, np.minimum(low[a], low[before]), start[a] - 1), low[a])
    high_single = np.where(right_side[a], high[a], np.where(near[a], np.maximum(high[a], high[after]), end[a] + 1))
    return named, start[a], end[b], np.where(pair, low[a], low_single), np.where(pair, high[b], high_single), doc[a]


class Symbols:
    """The symbols of a level, their counting keys, and which of them are known to occur once."""

    def __init__(self, tokens: np.ndarray, first: np.ndarray):
        at = np.arange(len(tokens))
        self.symbols = (tokens, at, at + 1, at, at + 1, owners(first))
        self.dead = np.zeros(len(tokens), dtype=bool)
        self.first = first

    def next_level(self, spans: Spans, window: int, level: int) -> Symbols:
        """The symbols after a round; those that hold a dead one are dead."""
        out = Symbols.__new__(Symbols)
        out.first = self.first
        out.symbols = name, start, end, low, high, doc = pairs(*runs(*self.symbols), salt=2 * level + 1)
        before = np.concatenate(([0], np.cumsum(self.dead)))
        held = self.symbols[1]
        out.dead = before[np.searchsorted(held, end)] > before[np.searchsorted(held, start)]
        # a symbol whose range leaves the document or is longer than a window lies in no window
        out.inside = (low >= self.first[doc]) & (high <= self.first[doc + 1]) & (high - low <= window)
        out.key = np.zeros(len(name), dtype=np.uint64)
        a, b, s, e = (x[out.inside] for x in (low, high, start, end))
        out.key[out.inside] = mix(spans.of(a, b) ^ mix(((s - a) * (1 << 32) + (e - a)).astype(np.uint64) * _STEP))
        return out

    def live(self) -> np.ndarray:
        return self.inside & ~self.dead

    def look_up(self, counts: Frequency) -> None:
        at = np.flatnonzero(self.live())
        self.dead[at[counts.occurrences(self.key[at]) == 0]] = True


def levels(tokens: np.ndarray, first: np.ndarray, spans: Spans, window: int, rounds: int, tables: list[Frequency]) -> list[Symbols]:
    """The symbols of each level; the tables say which symbols of the first levels occur once."""
    found, now = [], Symbols(tokens, first)
    for r in range(rounds):
        now = now.next_level(spans, window, r)
        if r < len(tables):
            now.look_up(tables[r])
        found.append(now)
    return found


def name_rounds(docs: DataFrame, places: Places, rank: str, window: int, rounds: int) -> list:
    """A Spark job for every round but the last: which symbols of its level occur twice, as broadcast tables."""
    context = docs.sparkSession.sparkContext
    octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    layout = Layout.of(octets // 10)
    tables: list = []
    for r in range(rounds - 1):

        def run(batches: Iterator[pa.RecordBatch], known=tuple(tables), r=r) -> Iterator[pa.RecordBatch]:
            def keys() -> Iterator[np.ndarray]:
                method = words_method(window, rounds, known)
                for batch in batches:
                    for piece in pieces(batch, method, places, rank):
                        if len(piece.tokens) >= window:
                            symbols = levels(piece.tokens, piece.first, Spans(piece.tokens), window, r + 1, [t.value for t in known])[-1]
                            yield symbols.key[symbols.live()]

            return counted(keys(), layout, LOOK[-1])

        tables.append(context.broadcast(frequency(docs.select(rank, "text").mapInArrow(frugal(run), "range int, hashes binary"), layout, LOOK)))
    return tables


def least_in_ranges(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(values[a..b]) for short ranges, by tables of minima over powers of two."""
    width = b - a + 1
    out = np.empty(len(a), dtype=values.dtype)
    level, size = values, 1
    while True:
        here = (width >= size) & (width < 2 * size)
        out[here] = np.minimum(level[a[here]], level[b[here] - size + 1])
        if not (width >= 2 * size).any():
            return out
        level = np.minimum(level[:-size], level[size:])
        size *= 2


def window_groups(tokens: np.ndarray, first: np.ndarray, spans: Spans, window: int, rounds: int = ROUNDS, tables: list[Frequency] | tuple = ()) -> Groups:
    found = levels(tokens, first, spans, window, rounds, tables)
    lengths = np.maximum(np.diff(first) - window + 1, 0)
    at = np.repeat(first[:-1] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    # windows around a dead symbol's range occur once
    gone = np.zeros(len(tokens) + 1, dtype=np.int64)
    for level in found:
        dead = level.inside & level.dead
        low, high = level.symbols[3][dead], level.symbols[4][dead]
        np.add.at(gone, np.maximum(high - window, 0), 1)
        np.add.at(gone, low + 1, -1)
    at = at[np.cumsum(gone)[at] == 0]
    last = found[-1]
    name, start, _, low, high, _ = last.symbols
    # ranges follow each other as the symbols do
    a = np.searchsorted(low, at, side="left")
    b = np.searchsorted(high, at + window, side="right") - 1
    some = a <= b
    order, place_of = ordered(mix(name ^ _STEP))
    symbol = np.full(len(at), -1, dtype=np.int64)
    if some.any():
        symbol[some] = place_of(least_in_ranges(order, a[some], b[some]))
    head = np.ones(len(at), dtype=bool)
    head[1:] = (symbol[1:] != symbol[:-1]) | (symbol[1:] < 0) | (at[1:] != at[:-1] + 1)
    group = np.flatnonzero(head)
    own, place = symbol[group], at[group]
    key = np.zeros(len(group), dtype=np.uint64)
    key[own >= 0] = last.key[own[own >= 0]]
    key[own < 0] = spans.of(place[own < 0], place[own < 0] + window)
    return Groups(key, place, np.diff(np.append(group, len(at))), np.where(own < 0, place, start[own]))


def word_piece(data: np.ndarray, begin: int, window: int) -> tuple[int, int | None, int]:
    """Cuts a long text after a word; the next piece starts a window (less one word) before the end."""
    size = CHUNK
    while begin + size < len(data):
        space = np.flatnonzero(SPACE[data[begin + size : begin + 2 * size]])
        if len(space):
            end = begin + size + int(space[0])
            starts, _, _ = word_bounds(data[begin:end], np.array([0, end - begin]))
            if len(starts) >= 2 * window:
                skipped = len(starts) - window + 1
                return end, begin + int(starts[skipped]), skipped
        size *= 2
    return len(data), None, 0


def words_method(window: int, rounds: int, tables=()) -> Method:
    return Method(window, word_tokens, word_piece, Spans, lambda tokens, first, spans: window_groups(tokens, first, spans, window, rounds, [t.value for t in tables]))


def cut_words(docs: DataFrame, places: Places, rank: str, spans: DataFrame, digest_only: bool, measures: bool) -> DataFrame:
    """`docs` with text of kept words joined by single spaces where something was removed, and the measures."""
    new = ("n_words", "n_removed", "kept_sha256") if measures else ()
    columns = [c for c in docs.columns if c != rank and c not in new and not (digest_only and c == "text")]

    def cut(batch: pa.RecordBatch, ranges: list[np.ndarray | None]) -> Iterator[pa.RecordBatch]:
        at = 0
        for part, offsets, data in text_chunks(batch):
            data = data.tobytes()
            texts, n_words, n_removed, digests = [], [], [], []
            for i, gone in enumerate(ranges[at : at + part.num_rows]):
                if gone is None and not measures:
                    texts.append(None)
                    continue
                words = data[offsets[i] : offsets[i + 1]].split()
                kept = words
                if gone is not None:
                    kept = list(compress(words, ~covered_tokens(len(words), gone)))
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                joined_text = b" ".join(kept)
                if measures:
                    digests.append(sha256(joined_text).hexdigest())
                texts.append(joined_text.decode(errors="replace") if len(kept) < len(words) else None)
            at += part.num_rows
            out = []
            for c in columns:
                old = part.column(c)
                if c == "text" and any(t is not None for t in texts):
                    new_texts = pa.array(texts, old.type)
                    old = pc.if_else(new_texts.is_valid(), new_texts, old)
                out.append(old)
            measured = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())] if measures else []
            yield pa.RecordBatch.from_arrays([*out, *measured], names=[*columns, *new])

    fields = [f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    kinds = ["n_words long", "n_removed long", "kept_sha256 string"] if measures else []
    return cut_by_spans(docs, spans, places, rank, cut, ", ".join([*fields, *kinds]))


def dedup_words(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, digest_only: bool = False, measures: bool = True) -> DataFrame:
    """`docs` without words inside windows of `window` words that also start earlier.

    Earlier means a smaller doc_id, or the same document and an earlier start. With
    `measures`, n_words, n_removed and kept_sha256 are added (columns of these names are
    replaced). A text that loses nothing stays as it is, any other becomes its kept words
    joined by one space. Null and empty texts have no words. A null doc_id comes before
    all others; several rows without one, or different texts under one doc_id, are
    documents of their own in order of a hash of their texts; rows that repeat doc_id and
    text are one document, so none removes the other. An empty table gives an empty result.
    Texts of any length are read in overlapping pieces. Words are compared as bytes; bytes
    that are no UTF-8 become U+FFFD where a text is cut, and count as they are in the digest.
    """
    small_batches(docs.sparkSession)
    rank = unused("rank", set(docs.columns))
    docs, places = numbered(docs, rank)
    method = words_method(window, rounds, tuple(name_rounds(docs, places, rank, window, rounds)))
    spans = find_repeats(docs, method, places, rank, "recompression", first_of_groups)
    return cut_words(docs, places, rank, spans, digest_only, measures)


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(table(spark, sf_dir, "documents").select("doc_id", "text"), digest_only=True)


SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM words, unnest(range(1, len(w) - 18)) AS t(i) WHERE len(w) >= 20),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM repeated, unnest(range(0, 20)) AS t(k)),
lost AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, w, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS k
  FROM words LEFT JOIN lost USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
