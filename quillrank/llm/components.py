"""Connected components of links, by star contraction in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.shared import discard, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """node, root (smallest node of its component) for every node of `edges` (u, v).

    Each round links all larger neighbours of a node to its smallest neighbour, then all
    neighbours of a node to the smallest of them; rounds stop when nothing changes. Only
    two numbers per round reach the driver. A node's neighbours are never gathered: the
    smallest one is an aggregate that is joined back.
    """

    def to_least(pairs: DataFrame, all_neighbours: bool) -> DataFrame:
        both = pairs if not all_neighbours else pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")) if all_neighbours else both.groupBy("u").agg(F.min("v").alias("least"))
        found = both.join(least, "u")
        if all_neighbours:
            return found.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        return found.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(found.select("u", F.col("least").alias("v")))

    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label, small=True)
    state = _state(edges)
    while True:
        wide = to_least(edges, True).where("u <> v").distinct()
        before, edges = edges, stored(to_least(wide, False).where("u <> v").distinct(), label, small=True)
        discard(before)
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
