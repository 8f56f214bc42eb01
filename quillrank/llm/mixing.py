"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.llm.shared import clean_text, table, unused, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
SEED = 17


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: source, source_size, target, rate (= target / size).

    Sources in order of code points, null last, take the weights in turn and share
    the total size. A target stops at `most` times its source's size and the excess
    is shared again by weight. That ends where target = min(most * size, level *
    weight), so the level follows from the sources ordered by size over weight:
    the first ones are full, the others share what is left. The windows here run over
    one row per source, never over documents.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((turn - 1) % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    level = (F.sum("source_size").over(everything) - full) / F.sum("weight").over(after)
    filled = (
        totals.withColumn("weight", weight)
        .withColumn("level", level)
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("source_size") * F.lit(most))
    )
    # the first source that is not full sets the level for all that follow it
    level = F.min(F.when(~F.col("capped"), F.struct("fill", "level"))).over(everything)["level"]
    filled = filled.withColumn("fill", F.row_number().over(by_fill)).withColumn("level", level)
    filled = filled.withColumn("capped", F.coalesce(F.col("level") * F.col("weight") >= F.col("source_size") * F.lit(most), F.lit(True)))
    target = F.when(F.col("capped"), (F.col("source_size") * most).cast("double")).otherwise(F.col("level") * F.col("weight"))
    # a source without words has target 0 and is not taken
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("capped"), F.lit(float(most))).otherwise(target / F.col("source_size"))
    return filled.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the hash of a key; the same on every run."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def _planned(docs: DataFrame, weights: tuple[float, ...], most: int, seed: int) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with size, source_size, target and copies under names that it doesn't have, and these names."""
    taken = set(docs.columns)
    name = {c: unused(c, taken) for c in ("size", "source_size", "target", "copies", "rate", "known_source")}
    base = docs.withColumn(name["size"], word_count(clean_text()))
    targets = source_targets(base.select("source", F.col(name["size"]).alias("size")), weights, most)
    targets = targets.select(F.col("source").alias(name["known_source"]), *(F.col(c).alias(name[c]) for c in ("source_size", "target", "rate")))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rate = F.coalesce(F.col(name["rate"]), F.lit(0.0))
    extra = (uniform(key, seed) < rate - F.floor(rate)).cast("int")
    joined = base.join(targets, F.col("source").eqNullSafe(F.col(name["known_source"])), "left")
    return joined.withColumn(name["copies"], (F.floor(rate) + extra).cast("int")).drop(name["known_source"], name["rate"]), name


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """`docs` with size, source_size, target and copies (how often the mix takes the row).

    copies = floor(rate) plus one with a probability of rate's fraction, decided by a
    hash of doc_id and the seed. A null text has size 0, a null source is a source of
    its own, rows that share a doc_id share the decision, a null doc_id hashes as the
    word null; a text of any length counts whole; an empty table gives an empty result.
    Other columns pass through; columns of the names that are added here are replaced.
    """
    return _planned(docs.drop("size", "source_size", "target", "copies"), weights, most, seed)[0]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every row of `docs` as often as plan_mix() says, with its own columns whatever their names."""
    planned, name = _planned(docs, weights, most, seed)
    copies = planned.where(F.col(name["copies"]) > 0).select("*", F.explode(F.sequence(F.lit(1), F.col(name["copies"]))))
    return copies.select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return planned.select("doc_id", "size", "source_size", "target", taken, "copies")


SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM totals),
leveled AS (
  SELECT *, row_number() OVER w AS fill,
    (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW w AS (ORDER BY source_size / weight, source IS NULL, source)),
capped AS (SELECT *, level * weight >= 3 * source_size AS full_up FROM leveled),
shares AS (SELECT min_by(level, fill) AS shared FROM capped WHERE NOT full_up),
final AS (SELECT source, source_size, weight, shared, coalesce(shared * weight >= 3 * source_size, true) AS full_up FROM capped CROSS JOIN shares),
targets AS (
  SELECT source, source_size, CASE WHEN full_up THEN (3 * source_size)::DOUBLE ELSE shared * weight END AS target,
    CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN full_up THEN 3.0::DOUBLE ELSE shared * weight / source_size END AS rate FROM final),
taken AS (
  SELECT doc_id, size, source_size, target, (floor(coalesce(rate, 0)) + CASE WHEN
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':17'), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE
      < coalesce(rate, 0) - floor(coalesce(rate, 0)) THEN 1 ELSE 0 END)::INT AS copies
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM taken
"""
