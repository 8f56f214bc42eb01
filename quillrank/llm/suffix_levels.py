"""Substring dedup over a logarithmic family of suffix indexes.

A suffix array of every byte is not needed to find matches of 100 bytes: each window of
100 bytes holds an anchor, the position whose next ANCHOR bytes hash lowest, and equal
windows hold it at the same place. The index keeps the suffixes at anchors only, sorted
by what follows (as hashes: the order beyond equality never matters here).

Documents come in batches in order of doc_id. A new batch's sorted suffixes are
merge-scanned (sort-merge joined) against the levels that exist; what is new becomes a
level, and levels of equal size merge, so every suffix is rewritten only
log2(batches) times.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.llm.arrays import Spans, mix, ordered, text_chunks
from quillrank.llm.repeats import CHUNK, Groups, Method, Places, covered_tokens, cut_by_spans, find_repeats, numbered
from quillrank.llm.shared import small_batches, stored, table, unused

WINDOW = 100
ANCHOR = 64
BATCHES = 4


def window_groups(tokens: np.ndarray, first: np.ndarray, spans: Spans, window: int, anchor: int = ANCHOR) -> Groups:
    n = len(tokens)
    at = np.arange(n - anchor + 1)
    gram = spans.of(at, at + anchor)
    least, place_of = ordered(gram)
    width, size = window - anchor + 1, 1
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    lengths = np.maximum(np.diff(first) - window + 1, 0)
    place = np.repeat(first[:-1] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    chosen = place_of(least[place])
    head = np.ones(len(place), dtype=bool)
    head[1:] = (chosen[1:] != chosen[:-1]) | (place[1:] != place[:-1] + 1)
    group = np.flatnonzero(head)
    # the least of many hashes is not spread evenly: mixed once more
    return Groups(mix(gram[chosen[group]]), place[group], np.diff(np.append(group, len(place))), chosen[group])


def byte_piece(data: np.ndarray, begin: int, window: int) -> tuple[int, int | None, int]:
    """Cuts a long text; the next piece starts a window (less one byte) before the end."""
    end = begin + CHUNK + window - 1
    return (end, begin + CHUNK, CHUNK) if end < len(data) else (len(data), None, 0)


def bytes_method(window: int, anchor: int = ANCHOR) -> Method:
    tokens = lambda data, offsets: (data.astype(np.uint64), offsets)
    return Method(window, tokens, byte_piece, lambda t: Spans(t, octets=True), lambda t, first, spans: window_groups(t, first, spans, window, min(anchor, window)))


class SuffixLevels:
    """Levels of (key, sh, occ) in the shared folder, dealt by key and in runs sorted by (key, sh)."""

    def __init__(self, label: str = "suffixes"):
        self.label = label
        self.levels: list[tuple[int, DataFrame]] = []
        self.tables: list[DataFrame] = []

    def entries(self) -> DataFrame:
        """All different groups with their first place."""
        return reduce(DataFrame.unionByName, (level for _, level in self.levels))

    def add(self, batch: DataFrame) -> DataFrame:
        """Match a batch (key, sh, occ, m; later places than any level), add what is new; returns the repeats.

        One sort by (key, sh) serves the match within the batch and the merge with the levels.
        """
        own = Window.partitionBy("key", "sh").orderBy("occ")
        # rows that repeat a doc_id repeat its places: one of them goes to the level, the others are no repeats
        rows = batch.withColumn("first", F.row_number().over(own) == 1).withColumn("later", F.col("occ") > F.min("occ").over(own))
        if self.levels:
            known = self.entries().select("key", "sh", F.lit(True).alias("known"))
            rows = rows.join(known.hint("merge"), ["key", "sh"], "left").withColumn("first", F.col("first") & F.col("known").isNull())
            rows = rows.withColumn("later", F.col("later") | F.col("known").isNotNull()).drop("known")
        rows = stored(rows, self.label, small=True)
        self.tables.append(rows)
        self.levels.append((1, rows.where("first").select("key", "sh", "occ")))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            merged = stored(a.unionByName(b).repartition("key").sortWithinPartitions("key", "sh"), self.label, small=True)
            self.tables.append(merged)
            self.levels.append((2 * size, merged))
        return rows.where("later")


def match_levels(groups: DataFrame, batches: int = BATCHES) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """All groups through the index family, batch by batch in order of place."""
    bounds = groups.select(F.percentile_approx("occ", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    edges = [None, *sorted(set(bounds)), None]
    family = SuffixLevels()
    fresh = groups.where("NOT again")
    whole = [groups.where("again").select("occ", "m")]
    for low, high in zip(edges, edges[1:], strict=False):
        batch = fresh
        if low is not None:
            batch = batch.where(F.col("occ") >= low)
        if high is not None:
            batch = batch.where(F.col("occ") < high)
        whole.append(family.add(batch.select("key", "sh", "occ", "m")).select("occ", "m"))
    entries = family.entries()
    mixed = entries.groupBy("key").agg(F.min("sh").alias("a"), F.max("sh").alias("b")).where("a <> b").select("key")
    return reduce(DataFrame.unionByName, whole), entries.join(mixed, "key", "left_semi").select("occ"), family.tables


def cut_bytes(docs: DataFrame, places: Places, rank: str, spans: DataFrame, keep: bool = True) -> DataFrame:
    new = ("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    columns = [c for c in docs.columns if c not in new and c not in ("text", rank)]

    def cut(batch: pa.RecordBatch, ranges: list[np.ndarray | None]) -> Iterator[pa.RecordBatch]:
        at = 0
        for part, offsets, data in text_chunks(batch):
            rows = []
            for i, removed in enumerate(ranges[at : at + part.num_rows]):
                own = data[offsets[i] : offsets[i + 1]]
                n_spans, rest = 0, own
                if removed is not None:
                    gone = covered_tokens(len(own), removed)
                    n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    rest = own[~gone]
                rest_bytes = rest.tobytes()
                rows.append((rest_bytes if keep else None, len(own), len(own) - len(rest), n_spans, sha256(rest_bytes).hexdigest()))
            at += part.num_rows
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *(pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*columns, *new])

    fields = [f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    return cut_by_spans(docs, spans, places, rank, cut, ", ".join([*fields, "kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"]))


def dedup_bytes(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, keep: bool = True) -> DataFrame:
    """`docs` without bytes inside strings of `window` bytes that also start earlier.

    The text column gives way to kept (binary: what remains need not be UTF-8), n_bytes,
    n_removed, n_spans and kept_sha256 (columns of these names are replaced). Null and
    empty texts have no bytes. A null doc_id comes before all others; several rows without
    one, or different texts under one doc_id, are documents of their own in order of a
    hash of their texts; rows that repeat doc_id and text are one document, so none
    removes the other. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rank = unused("rank", set(docs.columns))
    docs, places = numbered(docs, rank)
    spans = find_repeats(docs, bytes_method(window), places, rank, "suffix-levels", lambda groups: match_levels(groups, batches))
    return cut_bytes(docs, places, rank, spans, keep)


def op5_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False).drop("kept")


SQL = """
WITH octets AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (SELECT doc_id, i, b[i:i + 99] AS w, octet_length(b) AS n, hex(b[i:i]) AS octet FROM octets, unnest(range(1, octet_length(b) + 1)) AS t(i)),
windows AS (SELECT doc_id, i, octet, i + 99 <= n AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM places),
covered AS (SELECT doc_id, i, octet, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM windows),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM covered),
cut AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(octet, '' ORDER BY i) FILTER (NOT gone) AS kept FROM edges GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM octets LEFT JOIN cut USING (doc_id)
"""
