"""A cache of vectors by id: used as it is, put in order, or filled where ids are missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, key: str, place: str | None = None) -> DataFrame:
    """One row (n, hash): number and hash of the ids; with `place`, of the ids at their places.

    Sums of hashes of (place, id) are the same however rows are dealt over tasks and add up
    over parts; they differ as soon as two ids change places.
    """
    what = [F.col(key)] if place is None else [F.col(place), F.col(key)]
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*what).cast("decimal(38,0)")).alias("hash"))


def filled(cache: DataFrame, wanted: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> tuple[str, DataFrame]:
    """(how, id, place, embedding, new) for the ids of `wanted` (id, place, text), from `cache` (id, place, embedding).

    reused: the cache holds these ids at these places and is taken as it is. reordered: it
    holds these ids at other places. refilled: ids are missing; `encode` makes the vectors
    of those alone (id, embedding), and what nobody wants any more is left out.
    """
    same = lambda place: fingerprint(cache, "id", place).first() == fingerprint(wanted, "id", place).first()  # noqa: E731  one row each
    if same("place"):
        return "reused", cache.select("id", "place", "embedding", F.lit(False).alias("new"))
    known = wanted.select("id", "place").join(cache.select("id", "embedding"), "id").withColumn("new", F.lit(False))
    if same(None):
        return "reordered", known
    missing = wanted.join(cache.select("id"), "id", "left_anti")
    made = wanted.select("id", "place").join(encode(missing), "id").withColumn("new", F.lit(True))
    return "refilled", known.unionByName(made)
