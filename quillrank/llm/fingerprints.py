"""Threshold-scaled document sketches, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so the overlap
of two sketches estimates containment however unequal the documents are. Where no hash lies
below, the least one stands in; merged() forms the sketch of several parts from theirs: the
union of what lies below, or else the least of all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.llm.shared import WORD, clean_text, need_numbers, table

SHINGLE = 5
FRACTION = 4
HASH_BITS = 48


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, shingle: int = SHINGLE, fraction: int = FRACTION) -> Column:
    """Sorted distinct hashes of the word shingles that lie in the lowest 1/fraction.

    A text with fewer words than a shingle counts as one shingle; a text without words
    (or null) has an empty sketch.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def hashes(w: Column) -> Column:
        last = F.greatest(F.size(w) - shingle, F.lit(0))
        at = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(shingle)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftrightunsigned(at(i), 64 - HASH_BITS)))

    def kept(h: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(h, lambda x: x < (1 << HASH_BITS) // fraction)))
        return F.when((F.size(low) == 0) & (F.size(h) > 0), F.array(F.array_min(h))).otherwise(low)

    # xxhash64 of each word first: the shingle hash then works on longs
    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda w: let(hashes(w), kept))


def merged(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """The sketch of the shingles of two sketches: that of all their shingles together."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda x: x < (1 << HASH_BITS) // fraction)
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other one holds; two empty sketches are alike."""
    small = F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(small == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / small)


def as_text(s: Column) -> Column:
    return F.lower(F.array_join(F.transform(s, lambda x: F.hex(x)), ","))


_STEP = 64
_PARTS_LOG2 = 4  # ranges of one doc_id that holds much of the table


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most `value`; looks at every 64th cut, then at 64 of them."""
    if not cuts:
        return F.lit(0)
    array = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    below = lambda values, v: F.size(F.filter(values, lambda c: c <= v))
    coarse = cuts[_STEP - 1 :: _STEP]
    if not coarse:
        return below(array(cuts), value)
    return let(below(array(coarse), value), lambda k: k * _STEP + below(F.slice(array(cuts), k * _STEP + 1, _STEP), value))


def with_next(docs: DataFrame, made: dict[str, Callable[[Column], Column]], buckets: int | None = None) -> DataFrame:
    """`docs` (doc_id, text) with the columns `made` of text, and next_text and next_<column> of the next row.

    The next row is the one after in descending doc_id; the last row gets the first. Rows
    that share a doc_id are ordered by a hash of the text, then by the text; null doc_ids
    come last. Rows are cut into ranges of doc_id at sampled quantiles (a doc_id that fills
    several ranges, and nulls, by the hash too), so each task orders one range; only the
    first row of every range is passed to the range before it. The text is shuffled once.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or []
    often = sorted({c for c, d in zip(cuts, cuts[1:]) if c == d})
    order, part = F.shiftrightunsigned(F.xxhash64("text"), 1), F.shiftrightunsigned(F.xxhash64("text"), 64 - _PARTS_LOG2)
    known = F.col("doc_id").cast("long")
    split = known.isin(often) if often else F.lit(False)
    number = F.when(known.isNull(), F.lit(-1)).otherwise(_range_of(known, sorted(set(cuts)))) * (1 << _PARTS_LOG2)
    bucket = number + F.when(known.isNull() | split, (1 << _PARTS_LOG2) - 1 - part).otherwise(F.lit((1 << _PARTS_LOG2) - 1)).cast("int")
    rows = docs.withColumn("_bucket", bucket).withColumn("_order", order)
    place = F.struct(F.bitwise_not(F.coalesce(known, F.lit(0))).alias("id"), "_order")
    least = rows.groupBy("_bucket").agg(F.min(place).alias("_least"))  # a row per range, of numbers only
    heads = rows.join(F.broadcast(least.withColumnRenamed("_bucket", "_b")), (F.col("_bucket") == F.col("_b")) & (place == F.col("_least")))
    heads = heads.groupBy("_bucket").agg(F.min("text").alias("_text"))
    ring = Window.orderBy(F.col("_bucket").desc())  # one row per range, a number; texts are joined by it
    first = F.first("_bucket").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = least.select("_bucket", F.coalesce(F.lead("_bucket").over(ring), first).alias("_b"))
    heads = before.join(heads.withColumnRenamed("_bucket", "_b"), "_b").select("_bucket", "_text")
    for name, body in made.items():
        heads = heads.withColumn(name, body(F.col("_text")))
    carried = ["text", *made]
    heads = heads.select("_bucket", F.struct(F.col("_text").alias("text"), *made).alias("_head"))
    rows = rows.repartition("_bucket")
    for name, body in made.items():
        rows = rows.withColumn(name, body(F.col("text")))
    inside = Window.partitionBy("_bucket").orderBy(F.col("doc_id").desc_nulls_last(), "_order", "text")
    rows = rows.withColumn("_next", F.lead(F.struct(*carried)).over(inside))
    rows = rows.join(heads, "_bucket", "left").withColumn("_next", F.coalesce("_next", "_head"))
    return rows.select("doc_id", *carried, *(F.col("_next")[c].alias(f"next_{c}") for c in carried))


def edited(text: Column, following: Column) -> Column:
    """`text` whose last third (floor) of code points gives way to as many of `following`'s first."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, with their likeness."""
    return fingerprints(table(spark, sf_dir, "documents"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next per row of `docs`.

    Null texts are empty and have empty fingerprints; an empty table gives an empty result;
    a single document is its own next document; equal texts have equal fingerprints,
    repeated rows follow each other. A text of any length is sketched whole. doc_id must be
    a whole number (or null), else a ValueError names it. Other columns of `docs` are not read.
    """
    need_numbers(docs, "doc_id")
    docs = docs.select("doc_id", clean_text().alias("text"))
    rows = with_next(docs, {"sketch": sketch}).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
