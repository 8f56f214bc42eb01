"""BM25 and dense similarity against a fixed query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.exprs import dot
from quillrank.functions.lexicon import tokens


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """key, bm25: score of each document; a query term that repeats counts as often.

    idf below zero becomes a quarter of the mean idf of the whole vocabulary (the mean is
    taken before). One pass aggregates the vocabulary, one the lengths; a third scores each
    document where it is, by a broadcast row as long as the query: documents are not shuffled.
    For many queries over one corpus, postings.build() keeps an index.
    """
    words = docs.select(F.col(key), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    totals = words.agg(F.count("*").alias("_n"), F.avg(F.size("_w")).alias("_avg"))
    df = words.select(F.explode(F.array_distinct("_w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.col("_n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    times = {t: query.count(t) for t in query}
    often = F.coalesce(F.create_map(*(F.lit(x) for pair in times.items() for x in pair))[F.col("term")], F.lit(0)) if times else F.lit(0)
    vocabulary = df.crossJoin(F.broadcast(totals)).select("term", "_avg", idf.alias("idf"), often.alias("often"))
    # one row: the mean of all idf, and idf of the query's terms
    asked = F.collect_list(F.when(F.col("often") > 0, F.struct("term", "idf", "often")))
    stats = vocabulary.agg(F.avg("idf").alias("_mean"), F.first("_avg").alias("_avg"), F.array_sort(asked).alias("_asked"))

    def part(t: Column) -> Column:
        weight = F.when(t["idf"] < 0, 0.25 * F.col("_mean")).otherwise(t["idf"]) * t["often"]
        tf = F.size(F.filter("_w", lambda w: w == t["term"]))
        return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("_w") / F.col("_avg")))

    score = F.aggregate(F.coalesce("_asked", F.array().cast("array<struct<term:string,idf:double,often:int>>")), F.lit(0.0), lambda s, t: s + part(t))
    return words.crossJoin(F.broadcast(stats)).select(key, F.coalesce(score, F.lit(0.0)).alias("bm25"))


def mean_vector(vectors: DataFrame, column: str) -> DataFrame:
    """One row `anchor`: the mean of unit vectors, renormalised."""
    parts = vectors.select(F.posexplode(column)).groupBy("pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    whole = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("v"))
    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    return whole.select(F.transform("v", lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm)).alias("anchor"))


def dense_features(vectors: DataFrame, column: str, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """dense_sim_pos, dense_sim_neg, dense_margin against two one-row anchors."""
    anchors = positive.withColumnRenamed("anchor", "_pos").crossJoin(negative.withColumnRenamed("anchor", "_neg"))
    out = vectors.crossJoin(F.broadcast(anchors))
    out = out.withColumn("dense_sim_pos", dot(F.col(column), F.col("_pos"))).withColumn("dense_sim_neg", dot(F.col(column), F.col("_neg")))
    return out.withColumn("dense_margin", F.col("dense_sim_pos") - F.col("dense_sim_neg")).drop("_pos", "_neg")


def hashed(docs: DataFrame, key: str, text: str, size: int = 384) -> DataFrame:
    """key, vector: unit vectors of signed feature hashing, a stand-in where no encoder model is at hand.

    The first eight hex digits of a token's md5 choose its place, the ninth its sign. A text
    is counted in its own row, linear but for the sort of its codes: nothing is exploded or
    shuffled, and a task holds one text at a time. A text without tokens has the zero vector.
    """
    digest = lambda w: F.md5(w)
    place = lambda h: (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % size).cast("int")
    code = lambda h: 2 * place(h) + F.when(F.substring(h, 9, 1) < "8", 0).otherwise(1)
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  computes the value once
    # every code once more than it occurs, sorted: code c begins at the c-th start
    codes = F.array_sort(F.concat(F.transform(F.transform(F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")), digest), code), F.sequence(F.lit(0), F.lit(2 * size - 1))))
    starts = lambda c: F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == 0) | (F.get(c, i) != F.get(c, i - 1)))
    with_end = lambda c: F.concat(starts(c), F.array(F.size(c)))
    sums = let(codes, lambda c: let(with_end(c), lambda s: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (2 * F.get(s, 2 * i + 1) - F.get(s, 2 * i) - F.get(s, 2 * i + 2)).cast("double"))))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))
    unit = lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return docs.select(key, let(sums, unit).alias("vector"))
