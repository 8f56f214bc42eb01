"""Exact removal of repeated windows: the Spark jobs that both repeat operators share.

A window is L consecutive tokens of one document. A token is removed if a window that
covers it has the same content as a window that starts earlier. The operators differ in
how they choose *anchors*: places that depend only on the text near them, so that equal
windows hold the same anchor at the same distance. Windows that share an anchor follow
each other, so they travel as one *group*: (key, sh, occ, m) = hash of the anchor's
surroundings, hash of the whole group, place of its first window, number of windows.

1. Anchor keys are counted; only keys that occur twice can belong to repeats. They go into
   a bit table of bounded size, the only thing that is broadcast.
2. Groups with such keys: a group whose content occurred before is a repeat as a whole.
3. Keys that keep several different groups (borders of repeats, edited copies): the
   windows of each group's first occurrence are compared one by one. Later occurrences
   of a group are repeats already, so they add nothing.
4. Spans per document are joined with the texts and cut.

Contents are compared by two independent 64-bit hashes (key, and group or window). Each
task first drops what repeats inside what it holds, so any one content sends a row per
FLUSH rows to a shuffle, however often it occurs. A text longer than CHUNK is read in
pieces that overlap by a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.llm.arrays import Spans, frugal, mix, text_chunks
from quillrank.llm.bits import bit_table, bits_for, in_table
from quillrank.llm.frequency import Frequency, Layout, counted, frequency
from quillrank.llm.shared import discard, small_batches, stored, unused

CHUNK = 1 << 18  # bytes of text at a time: some dozen arrays of eight bytes per byte of it
FLUSH = 1 << 19  # rows that a task holds to drop what repeats in them
LOOK = (2,)  # the only level of occurrences that matters here
#: (tokens, first token of each document) of a chunk
Tokens = tuple[np.ndarray, np.ndarray]


@dataclass
class Groups:
    """Groups of windows in a chunk: anchor key, first window's token index, windows, distance of anchor."""

    key: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray


@dataclass
class Method:
    """How texts become tokens and where anchors lie.

    `tokens(data, offsets)` tokenises a chunk, `piece(data, begin, window)` cuts one long
    text: (end of the piece that starts at byte `begin`, start of the next piece or None,
    tokens between the two starts), `spans(tokens)` hashes spans of tokens and
    `groups(tokens, first, spans)` finds the groups.
    """

    window: int
    tokens: Callable[[np.ndarray, np.ndarray], Tokens]
    piece: Callable[[np.ndarray, int, int], tuple[int, int | None, int]]
    spans: Callable[[np.ndarray], Spans]
    groups: Callable[[np.ndarray, np.ndarray, Spans], Groups]


@dataclass
class Places:
    """Packs (document rank, token) into one long that orders alike: (doc_id - least + 1) << shift | token."""

    least: int
    shift: int

    def docs(self, ids: pa.Array) -> np.ndarray:
        some = ids.cast(pa.int64())
        return np.where(some.is_null().to_numpy(zero_copy_only=False), 0, some.fill_null(self.least).to_numpy(zero_copy_only=False) - self.least + 1)


def numbered(docs: DataFrame, rank: str) -> tuple[DataFrame, Places]:
    """(`docs` with the column `rank` that orders rows as doc_id does, how it is packed).

    Where doc_id is unique, has at most one null (which comes first) and fits beside the
    longest text in 63 bits, the rank is doc_id itself. Otherwise the different
    (doc_id, text) are numbered: nulls first, different texts under one doc_id by a hash
    of the text. Rows that repeat both have one rank: they are one document.
    """
    row = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text")), F.count("*"), F.count("doc_id")).first()
    least, most, longest, rows, known = row[0], row[1], row[2] or 0, row[3], row[4]
    shift = max(1, int(longest).bit_length())
    whole = isinstance(least or 0, int)
    unique = rows - known < 2 and docs.select("doc_id").distinct().count() == rows
    if whole and unique and ((most or 0) - (least or 0) + 2).bit_length() + shift <= 63:
        return docs.withColumn(rank, F.col("doc_id").cast("long")), Places(least or 0, shift)
    spark = docs.sparkSession
    tie = unused("tie", set(docs.columns))
    keys = docs.select("doc_id", F.struct(F.xxhash64("text"), F.sha2("text", 256)).alias(tie)).distinct()
    keys = keys.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    keys = stored(keys.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranks")
    before, total = [], 0
    for part, n in sorted(keys.groupBy("part").count().collect()):  # one row per partition
        before.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    ranks = keys.join(starts, "part").select(F.col("doc_id").alias("known_id"), F.col(tie).alias("known_tie"), (F.col("before") + F.col("at")).alias(rank))
    own = F.struct(F.xxhash64("text"), F.sha2("text", 256))
    joined = docs.join(ranks, F.col("doc_id").eqNullSafe(F.col("known_id")) & own.eqNullSafe(F.col("known_tie")), "left")
    if total.bit_length() + 1 + shift > 63:
        raise ValueError("more documents than fit beside the longest text in 63 bits; split the longest texts")
    return stored(joined.select(*docs.columns, rank), "ranked"), Places(0, shift)


@dataclass
class Piece:
    """Whole documents of a chunk, or a piece of one: `at` is the place of each document's first token here."""

    at: np.ndarray
    tokens: np.ndarray
    first: np.ndarray

    def places(self, token: np.ndarray) -> np.ndarray:
        doc = np.searchsorted(self.first, token, side="right") - 1
        return self.at[doc] + token - self.first[doc]


def pieces(batch: pa.RecordBatch, method: Method, places: Places, rank: str) -> Iterator[Piece]:
    """The batch's documents in order of rank, at most about CHUNK bytes at a time."""
    ids = places.docs(batch.column(rank))
    batch = batch.take(pa.array(np.argsort(ids, kind="stable")))
    for part, offsets, data in text_chunks(batch, limit=CHUNK):
        at = places.docs(part.column(rank)) << places.shift
        if len(data) <= 2 * CHUNK:
            yield Piece(at, *method.tokens(data, offsets))
            continue
        begin: int | None = 0  # a single long text
        while begin is not None:
            end, following, skipped = method.piece(data, begin, method.window)
            yield Piece(at.copy(), *method.tokens(data[begin:end], np.array([0, end - begin])))
            begin, at = following, at + skipped


def _chunks(batches: Iterator[pa.RecordBatch], method: Method, places: Places, rank: str) -> Iterator[tuple[Piece, Groups, Spans]]:
    for batch in batches:
        for piece in pieces(batch, method, places, rank):
            if len(piece.tokens) >= method.window:
                spans = method.spans(piece.tokens)
                yield piece, method.groups(piece.tokens, piece.first, spans), spans


def flushed(parts: Iterator[tuple[np.ndarray, ...]], limit: int = FLUSH) -> Iterator[tuple[np.ndarray, ...]]:
    """Tuples of arrays joined to tuples of at least `limit` rows (but for the last)."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= limit:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def first_of_each(occ: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, again): where a combination of keys has its least place, and where a later one than that.

    Rows that repeat a document repeat its places: these are neither, as their document
    holds the content no earlier.
    """
    order = np.lexsort((occ, *keys[::-1]))
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    place = occ[order]
    first, again = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    first[order] = new
    again[order] = place > place[new][np.cumsum(new) - 1]
    return first, again


def anchor_table(docs: DataFrame, method: Method, places: Places, rank: str) -> Frequency:
    """Which anchor keys may occur twice."""
    layout = Layout.of((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 16)

    def run(batches):
        return counted((g.key for _, g, _ in _chunks(batches, method, places, rank)), layout, LOOK[-1])

    return frequency(docs.select(rank, "text").mapInArrow(frugal(run), "range int, hashes binary"), layout, LOOK)


def repeated_groups(docs: DataFrame, method: Method, places: Places, rank: str, wanted) -> DataFrame:
    """key, sh, occ, m of groups whose key is in the table.

    Groups that the task has seen earlier (`again`) come as runs of m windows instead.
    """

    def found(batches):
        for piece, g, spans in _chunks(batches, method, places, rank):
            hit = np.flatnonzero(wanted.value.occurrences(g.key))
            start, count = g.start[hit], g.count[hit]
            content = spans.of(start, start + count - 1 + method.window)
            sh = mix(content + (g.anchor[hit] - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield g.key[hit].view(np.int64), sh.view(np.int64), piece.places(start), count

    def run(batches):
        for key, sh, occ, count in flushed(found(batches)):
            new, again = first_of_each(occ, key, sh)
            runs, length = joined_runs(occ[again], count[again])
            gone = np.zeros(len(runs), np.int64)
            out = (np.concatenate((key[new], gone)), np.concatenate((sh[new], gone)), np.concatenate((occ[new], runs)), np.concatenate((count[new], length)).astype(np.int32), np.arange(new.sum() + len(runs)) >= new.sum())
            yield pa.RecordBatch.from_arrays([*map(pa.array, out)], names=["key", "sh", "occ", "m", "again"])

    return docs.select(rank, "text").mapInArrow(frugal(run), "key long, sh long, occ long, m int, again boolean")


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection that carries places to all 64 bits; spread_column() is the same in Spark."""
    x = x.astype(np.int64).view(np.uint64)
    for _ in range(2):
        x = x ^ (x << np.uint64(13))
        x = x ^ (x >> np.uint64(7))
        x = x ^ (x << np.uint64(17))
    return x


def spread_column(name: str) -> Column:
    x = name
    for _ in range(2):
        x = f"({x} ^ shiftleft({x}, 13))"
        x = f"({x} ^ shiftrightunsigned({x}, 7))"
        x = f"({x} ^ shiftleft({x}, 17))"
    return F.expr(x)


def single_windows(docs: DataFrame, method: Method, places: Places, rank: str, wanted) -> DataFrame:
    """key (of the anchor), w (hash), occ, m = 1 of each window of the groups whose place is in the table.

    Windows that the task has seen earlier (`again`) come as runs of m windows instead.
    """

    def found(batches):
        for piece, g, spans in _chunks(batches, method, places, rank):
            hit = np.flatnonzero(in_table(wanted.value, spread(piece.places(g.start))))
            start, count = g.start[hit], g.count[hit]
            token = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
            yield np.repeat(g.key[hit], count).view(np.int64), spans.of(token, token + method.window).view(np.int64), piece.places(token)

    def run(batches):
        for key, w, occ in flushed(found(batches)):
            new, again = first_of_each(occ, key, w)
            runs, length = consecutive(np.unique(occ[again]))
            gone = np.zeros(len(runs), np.int64)
            out = (np.concatenate((key[new], gone)), np.concatenate((w[new], gone)), np.concatenate((occ[new], runs)), np.concatenate((np.ones(new.sum(), np.int32), length.astype(np.int32))), np.arange(new.sum() + len(runs)) >= new.sum())
            yield pa.RecordBatch.from_arrays([*map(pa.array, out)], names=["key", "w", "occ", "m", "again"])

    return docs.select(rank, "text").mapInArrow(frugal(run), "key long, w long, occ long, m int, again boolean")


def joined_runs(occ: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of windows, with those that follow each other joined."""
    if not len(occ):
        return occ, count
    order = np.argsort(occ, kind="stable")
    occ, end = occ[order], np.maximum.accumulate((occ + count)[order])
    starts = np.flatnonzero(np.concatenate(([True], occ[1:] > end[:-1])))
    last = np.append(starts[1:], len(occ)) - 1
    return occ[starts], end[last] - occ[starts]


def consecutive(occ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of consecutive numbers in a sorted array."""
    if not len(occ):
        return occ, occ
    starts = np.flatnonzero(np.concatenate(([True], np.diff(occ) > 1)))
    return occ[starts], occ[np.append(starts[1:], len(occ)) - 1] - occ[starts] + 1


def later(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that are not the first of their content; rows come at most once per content and FLUSH rows of a task."""
    return rows.withColumn("_least", F.min("occ").over(Window.partitionBy(*keys))).where("occ > _least").drop("_least")


def spans_of(removed: DataFrame, places: Places, window: int) -> DataFrame:
    """doc, spans: the removed token ranges [from, to) per document, joined; `removed` has occ, m."""
    at = F.col("occ").bitwiseAND((1 << places.shift) - 1)
    rows = removed.select(F.shiftright("occ", places.shift).alias("doc"), at.alias("a"), (at + F.col("m") - 1 + window).alias("b"))
    rows = rows.repartition("doc").sortWithinPartitions("doc", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ranges come in order; the last document of a batch may go on in the next one
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            doc, a, b = (np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, ("doc", "a", "b"), strict=True))
            doc, a, b = merged(doc, a, b)
            rest = np.searchsorted(doc, doc[-1]) if len(doc) else 0
            held = [x[rest:] for x in (doc, a, b)]
            if rest:
                yield listed(doc[:rest], a[:rest], b[:rest])
        if len(held[0]):
            yield listed(*held)

    return rows.mapInArrow(frugal(run), "doc long, spans array<struct<a: long, b: long>>")


def merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges in order of (doc, a), with those of one document that touch joined."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    far = int(b.max()) + 1  # ends of one document stay below the starts of the next one
    number = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
    end = np.maximum.accumulate(b + number * far)
    starts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (a[1:] + number[1:] * far > end[:-1]))))
    last = np.append(starts[1:], len(doc)) - 1
    return doc[starts], a[starts], end[last] - number[last] * far


def listed(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    ranges = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(doc)).astype(np.int32)), ranges)
    return pa.RecordBatch.from_arrays([pa.array(doc[begin]), lists], names=["doc", "spans"])


def covered_tokens(n: int, spans: np.ndarray) -> np.ndarray:
    """Which of n tokens the ranges [from, to) cover."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, np.minimum(spans[:, 0], n), 1)
    np.add.at(change, np.minimum(spans[:, 1], n), -1)
    return np.cumsum(change[:-1]) > 0


def find_repeats(docs: DataFrame, method: Method, places: Places, rank: str, label: str, match_groups: Callable[[DataFrame], tuple[DataFrame, DataFrame, list[DataFrame]]], table: Frequency | None = None) -> DataFrame:
    """doc, spans (a stored table): the token ranges that repeated windows cover, per rank.

    `match_groups` gets the stored groups and returns (groups that repeat an earlier
    one: occ, m; first occurrences of groups whose key has several different ones: occ;
    stored tables that these two read).
    `table` says which anchor keys may occur twice (counted here if it isn't given).
    """
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(table or anchor_table(docs, method, places, rank))
    groups = stored(repeated_groups(docs, method, places, rank, wanted), f"{label}-groups")
    whole, firsts, between = match_groups(groups)
    most = groups.where("NOT again").count()
    chosen = spark.sparkContext.broadcast(bit_table(firsts.select(spread_column("occ").alias("key")), bits_for(most, 8)))
    windows = single_windows(docs, method, places, rank, chosen)
    # runs that the task knew pass through beside the windows, each in a partition of its own place
    same = Window.partitionBy("again", F.when(F.col("again"), F.col("occ")).otherwise(F.col("w")), "key")
    single = windows.withColumn("_least", F.min("occ").over(same)).where("again OR occ > _least")
    removed = whole.select("occ", "m").unionByName(single.select("occ", "m"))
    spans = stored(spans_of(removed, places, method.window), f"{label}-spans", small=True)
    discard(groups, *between)
    return spans


Cut = Callable[[pa.RecordBatch, list[np.ndarray | None]], Iterator[pa.RecordBatch]]


def cut_by_spans(docs: DataFrame, spans: DataFrame, places: Places, rank: str, cut: Cut, schema: str) -> DataFrame:
    """`cut(rows, spans of each row or None)` over all rows of `docs`.

    Only texts that may have spans (by a bit table of their ranks) go through the join;
    all others are cut where they are, without a shuffle.
    """
    keys = spans.select(spread_column("doc").alias("key"))
    touched = docs.sparkSession.sparkContext.broadcast(bit_table(keys, bits_for(spans.count())))
    packed = F.coalesce(F.col(rank) - F.lit(places.least) + 1, F.lit(0)).cast("long")

    def has(batch: pa.RecordBatch, wanted: bool) -> pa.RecordBatch:
        hit = in_table(touched.value, spread(places.docs(batch.column(rank))))
        return batch.filter(pa.array(hit == wanted))

    def concerned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield has(batch, True)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = has(batch, False)
            yield from cut(batch, [None] * batch.num_rows)

    taken = set(docs.columns)
    known, name = unused("doc", taken), unused("spans", taken)
    found = spans.select(F.col("doc").alias(known), F.col("spans").alias(name))
    # merged, so that the two Python passes fall into two stages and no task holds two workers
    joined = docs.mapInArrow(frugal(concerned), docs.schema).join(found.hint("merge"), packed == F.col(known), "left").select(*docs.columns, name)

    def joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from cut(batch.select(docs_columns), list(span_arrays(batch.column(name))))

    docs_columns = docs.columns
    return joined.mapInArrow(frugal(joining), schema).unionByName(docs.mapInArrow(frugal(passing), schema))


def span_arrays(column) -> Iterator[np.ndarray | None]:
    """Each row's spans as an (n, 2) array; None where there are none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    pairs = np.column_stack([flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)]) if len(flat) else np.zeros((0, 2), np.int64)
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    begin = 0
    for end in ends:
        yield pairs[begin:end] if end > begin else None
        begin = end


def first_of_groups(groups: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(groups that repeat an earlier one, firsts of keys with several different groups), over all groups at once."""
    fresh = groups.where("NOT again")
    whole = groups.where("again").unionByName(later(fresh, "key", "sh"))
    mixed = fresh.groupBy("key").agg(F.min("sh").alias("a"), F.max("sh").alias("b")).where("a <> b").select("key")
    firsts = fresh.groupBy("key", "sh").agg(F.min("occ").alias("occ")).join(mixed, "key", "left_semi")
    return whole.select("occ", "m"), firsts.select("occ"), []
