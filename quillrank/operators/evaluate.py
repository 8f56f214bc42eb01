"""Ranking metrics, ablations, sweeps, bootstrap and audits as Spark jobs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.functions.exprs import clamp
from quillrank.functions.policy import DEFAULT, Policy
from quillrank.operators import scoring
from quillrank.operators.ranges import dealt, first_by_hash, marked_by_hash, nearest_rank, percentiles, running  # noqa: F401
from quillrank.sources.tables import stored

RELEVANT = 3


def best_of(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The k first rows of each key with their position; tasks keep k rows of a key before anything is shuffled."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("pos") <= k)


#: Rows at the top that gains look at.
DEPTH = 50


def _gain(tier: Column) -> Column:
    return F.pow(F.lit(2.0), tier.cast("double")) - 1


def _sums() -> list[Column]:
    """What a key's metrics need of its rows (tier, _hit) at their positions `pos`, with the hits `_seen` up to each."""
    dcg = lambda k: F.sum(F.when(F.col("pos") <= k, _gain(F.col("tier")) / F.log2(F.col("pos") + 1.0)).otherwise(0.0))
    precision = lambda k: F.sum(F.when(F.col("pos") <= k, F.coalesce("_hit", F.lit(0))).otherwise(0)) / float(k)
    average = F.sum(F.when(F.col("_hit") == 1, F.col("_seen") / F.col("pos"))) / F.count_if(F.col("_hit") == 1)
    return [dcg(10).alias("_dcg10"), dcg(DEPTH).alias("_dcg50"), precision(5).alias("p5"), precision(10).alias("p10"), average.alias("_map")]


def _ideal(tiers: DataFrame, keys: list[str]) -> DataFrame:
    """_ideal10 and _ideal50 of each key, from its numbers of rows by tier (tier, _n): rows of one tier gain the same."""
    until = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.col("tier").desc()))
    placed = tiers.withColumn("_until", until).withColumn("_from", F.col("_until") - F.col("_n"))
    shares = F.array(*(F.lit(sum(1 / log2(p + 1) for p in range(1, k + 1))) for k in range(DEPTH + 1)))  # of the first k places
    upto = lambda c, k: F.get(shares, F.least(F.col(c), F.lit(k)).cast("int"))
    ideal = lambda k: F.sum(_gain(F.col("tier")) * (upto("_until", k) - upto("_from", k)))
    return placed.groupBy(*(F.col(k).alias(f"_own{k}") for k in keys)).agg(ideal(10).alias("_ideal10"), ideal(DEPTH).alias("_ideal50"))


def _measured(sums: DataFrame, ideal: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the metrics, from _sums() and _ideal()."""
    out = sums.join(ideal, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_own{k}")) for k in keys)))
    ndcg = lambda k: F.when(F.col(f"_ideal{k}") > 0, F.col(f"_dcg{k}") / F.col(f"_ideal{k}")).otherwise(0.0).alias(f"ndcg{k}")
    out = out.select(*keys, ndcg(10), ndcg(50), F.coalesce("_map", F.lit(0.0)).alias("map"), "p5", "p10")
    return out.withColumn("composite", 0.5 * F.col("ndcg10") + 0.3 * F.col("ndcg50") + 0.15 * F.col("map") + 0.05 * F.col("p10"))


def metrics(df: DataFrame, key: str, score: str, id_: str = "id") -> DataFrame:
    """ndcg@10, ndcg@50, map, p@5, p@10 and composite per `key`; labelled rows only (column tier).

    Gains and precisions look at the 50 first rows by score and by tier; the average
    precision needs each hit's position and the hits before it among all rows of its key.
    Positions come from ranges of (key, score), so a variant of any size is never in one
    task; the best possible order follows from the numbers of rows by tier.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(score).alias("_score"), F.col(id_).alias("_id"), "tier", (F.col("tier") >= RELEVANT).cast("long").alias("_hit"))
    by_score = [F.col("_score").desc(), F.col("_id")]
    table = dealt(rows, "_key", *by_score)  # computed once, read three times
    sums = running(table.drop("_part"), ["_key"], by_score, "pos", {"_seen": ("sum", "_hit")}, table).groupBy("_key").agg(*_sums())
    ideal = _ideal(table.groupBy("_key", "tier").agg(F.count("*").alias("_n")), ["_key"])
    return _measured(sums, ideal, ["_key"]).withColumnRenamed("_key", key)


def variants(df: DataFrame, columns: dict[str, str], id_: str = "id", more: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per (variant, id) with the variant's score: the ablation's long form."""
    pairs = ", ".join(f"'{name}', cast(`{c}` as double)" for name, c in columns.items())
    return df.select(id_, "tier", *more, F.expr(f"stack({len(columns)}, {pairs}) as (variant, score)"))


def hashed_draw(n: Column, round_: Column, draw: Column, seed: int) -> Column:
    """A row number below n: the first 15 hex digits of md5('round:draw:seed') modulo n, in any engine."""
    digits = F.substring(F.md5(F.concat_ws(":", round_.cast("string"), draw.cast("string"), F.lit(str(seed)))), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % n


def resampled(spark: SparkSession, n: int, rounds: int, seed: int = 42, index: Callable[[Column, Column, Column, int], Column] = hashed_draw) -> DataFrame:
    """round, draw, idx: n draws of 0..n-1 in each round, with replacement; made where they are used, a range of numbers per task."""
    draws = spark.range(rounds * n).select((F.col("id") / F.lit(max(n, 1))).cast("long").alias("round"), (F.col("id") % F.lit(max(n, 1))).alias("draw"))
    return draws.withColumn("idx", index(F.lit(n).cast("long"), F.col("round"), F.col("draw"), seed))


#: Rows of a variant that one range of its order holds; the draws of a range in a round are sorted together.
DRAWN_ROWS = 1 << 14


def _ranked(rows: DataFrame, range_rows: int) -> DataFrame:
    """variant, idx, tier of `rows` (and score) with _rank, the rows of a better score; _part, its range; _cut, the parts of its ties.

    Rows of one score have one rank, since draws of equal score come as they are drawn. A
    score that more than `range_rows` rows share is cut by the numbers of its draws.
    """
    ties = rows.groupBy("variant", "score").agg(F.count("*").alias("_ties"))
    better = running(ties, ["variant"], [F.col("score").desc()], None, {"_until": ("sum", "_ties")})
    better = better.select(F.col("variant").alias("_v"), F.col("score").alias("_s"), "_ties", (F.col("_until") - F.col("_ties")).alias("_rank"))
    found = rows.join(better, F.col("variant").eqNullSafe(F.col("_v")) & F.col("score").eqNullSafe(F.col("_s")))
    cut = F.when(F.col("_ties") > range_rows, F.ceil(F.col("_ties") / range_rows)).otherwise(0)
    return found.select("variant", "idx", "tier", "_rank", F.floor(F.col("_rank") / range_rows).cast("int").alias("_part"), cut.cast("int").alias("_cut"))


def resampled_metrics(df: DataFrame, columns: dict[str, str], rounds: int, seed: int, index: Callable[[Column, Column, Column, int], Column] = hashed_draw, id_: str = "id", range_rows: int = DRAWN_ROWS) -> DataFrame:
    """variant, round and metrics of every resample; each round draws the same rows for all variants (variant -> score column).

    The order by score is cut into ranges once, not once a round: a draw knows its range by
    its row. At most 64 variants. A first pass over the draws only counts them by round, range and tier, which
    gives what lies before each range; a second one shuffles them, sorts each range of a
    round by itself and adds up. Draws are hashes, so they are made again and not stored.
    """
    names = list(columns)
    rows = stored(df.select(id_, "tier", *dict.fromkeys(columns.values())), "bootstrap-rows")  # ranges are drawn from it, which reads it twice
    numbered = stored(running(rows, [], [F.col(id_)], "idx").withColumn("idx", F.col("idx") - 1), "bootstrap")
    n = numbered.count()
    ranked = _ranked(variants(numbered, columns, "idx"), range_rows)
    # one number for variant and range, so that draws are shuffled and sorted as two numbers and their tier
    place = reduce(lambda a, b: a.when(F.col("variant") == names[b], b), range(1, len(names)), F.when(F.col("variant") == names[0], 0)).cast("long")
    ranked = stored(ranked.select("idx", "tier", (F.shiftleft(place, 34) + F.shiftleft(F.col("_part").cast("long"), 14)).alias("_place"), F.least("_cut", F.lit((1 << 14) - 2)).alias("_cut"), (F.col("_rank") * F.lit(n)).alias("_order")), "bootstrap-ranks")
    drawn = resampled(df.sparkSession, n, rounds, seed, index).join(ranked, "idx")
    sub = F.when(F.col("_cut") > 0, 1 + F.floor(F.col("draw") * F.col("_cut") / F.lit(max(n, 1)))).otherwise(0)  # ties that are cut come last in their range
    drawn = drawn.select((F.shiftleft("round", 40) + F.col("_place") + sub).alias("_group"), (F.col("_order") + F.col("draw")).alias("_order"), "tier")
    hit = (F.col("tier") >= RELEVANT).cast("long")
    key = F.shiftright("_group", 34).alias("_key")  # round and variant
    counts = stored(drawn.groupBy("_group", "tier").agg(F.count("*").alias("_n")), "bootstrap-counts")
    earlier = Window.partitionBy("_key").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy("_group").agg(F.sum("_n").alias("_n"), F.coalesce(F.sum(hit * F.col("_n")), F.lit(0)).alias("_h")).select("_group", key, "_n", "_h")
    before = sizes.select("_group", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before{c}") for c in ("_n", "_h")))
    inside = Window.partitionBy("_group").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = drawn.withColumn("_hit", hit).select("_group", "tier", "_hit", F.row_number().over(inside).alias("_at"), F.sum("_hit").over(inside).alias("_in"))
    placed = placed.join(before, "_group").select(key, "tier", "_hit", (F.col("_at") + F.col("_before_n")).alias("pos"), (F.coalesce("_in", F.lit(0)) + F.col("_before_h")).alias("_seen"))
    ideal = _ideal(counts.groupBy(key, "tier").agg(F.sum("_n").alias("_n")), ["_key"])
    found = _measured(placed.groupBy("_key").agg(*_sums()), ideal, ["_key"])
    variant = F.element_at(F.array(*map(F.lit, names)), (F.col("_key") % 64 + 1).cast("int"))
    return found.select(variant.alias("variant"), F.shiftright("_key", 6).alias("round"), *found.columns[1:])


def bootstrap(df: DataFrame, score: str, rounds: int = 1000, seed: int = 42, index: Callable[[Column, Column, Column, int], Column] = hashed_draw, id_: str = "id") -> DataFrame:
    """Mean, population deviation and 95 % interval of the composite metric over resampled rows.

    `df` has id, score and tier; rows are numbered by id in ranges. `index` chooses the row
    of each draw; the default draws with replacement. Draws of equal score come in the
    order in which they were drawn.
    """
    per = resampled_metrics(df, {"": score}, rounds, seed, index, id_)
    return per.agg(F.avg("composite").alias("mean"), F.stddev_pop("composite").alias("std"), F.expr("percentile(composite, 0.025)").alias("low"), F.expr("percentile(composite, 0.975)").alias("high"))


def bootstrap_variants(df: DataFrame, columns: dict[str, str], rounds: int = 1000, seed: int = 42, id_: str = "id") -> DataFrame:
    """bootstrap() of several variants (variant -> score column) at once; each round draws the same rows for all of them."""
    per = stored(resampled_metrics(df, columns, rounds, seed, id_=id_).select("variant", "composite"), "bootstrap-rounds")
    spread = percentiles(per, "composite", "variant", {"low": 0.025, "high": 0.975})
    means = per.groupBy("variant").agg(F.avg("composite").alias("mean"), F.stddev_pop("composite").alias("std"))
    return means.join(spread, "variant").select("variant", "mean", "std", "low", "high")


def sweep(df: DataFrame, grid: list[float], score: Column, id_: str = "id") -> DataFrame:
    """Metrics per parameter value p; `score` is a column over the row and `p`. The grid is a short list."""
    params = df.sparkSession.createDataFrame([(float(p),) for p in grid], "p double")
    return metrics(df.crossJoin(F.broadcast(params)).withColumn("_score", score), "p", "_score", id_)


def best_parameter(swept: DataFrame, metric: str = "composite") -> DataFrame:
    """The first parameter with the best metric; NaN never wins."""
    ok = swept.where(~F.isnan(metric) & F.col(metric).isNotNull())
    return ok.agg(F.max_by("p", F.struct(F.col(metric), -F.col("p"))).alias("best_p"), F.max(metric).alias("best_value"))


def health(scored: DataFrame, flags: dict[str, Column], n: int, *order: Column) -> DataFrame:
    """How many of the n best rows carry each flag."""
    return scored.orderBy(*order).limit(n).agg(*(F.count_if(c).alias(k) for k, c in flags.items()))


def ablation_table(df: DataFrame, columns: dict[str, str], flags: dict[str, Column], n: int, id_: str = "id") -> DataFrame:
    """Metrics per variant (variant -> score column) beside the flags among its n best rows; `df` has tier, null without a label."""
    df = stored(df.select(id_, "tier", *dict.fromkeys(columns.values()), *(F.coalesce(c, F.lit(False)).alias(f"_flag_{k}") for k, c in flags.items())), "ablation")
    scores = metrics(variants(df.where("tier IS NOT NULL"), columns, id_), "variant", "score", id_)
    long = variants(df, columns, id_, [f"_flag_{k}" for k in flags])
    top = best_of(long, "variant", n, F.col("score").desc(), F.col(id_))
    counts = top.groupBy("variant").agg(*(F.count_if(f"_flag_{k}").alias(k) for k in flags))
    return scores.join(counts, "variant")


#: Points of the sensitivity sweeps: (numerators, denominator).
GRIDS = {"blend": (range(21), 20.0), "offtarget_gate": (range(21), 40.0), "consistency_gate": (range(21), 100.0), "availability_floor": (range(6, 21), 20.0)}


def sensitivity(scored: DataFrame, policy: Policy = DEFAULT, model: str | None = None, id_: str = "id") -> DataFrame:
    """parameter, p and composite: each parameter of the final score alone moved over its grid.

    `scored` is what scoring.score() gives, with tier; `model` is a column of a model's
    score between 0 and 1, without which the blend is not moved.
    """
    fit = clamp(F.col("fit_raw"))
    c = lambda name: scoring.col(scored, name) > 0
    off, history, built = c("is_offtarget_current"), c("relevant_history_flag"), c("ever_built_relevant_flag")
    p, high = F.col("p"), policy.availability_band[1]
    parts = {
        "offtarget_gate": {"offtarget_gate": F.when(off & built, 0.7).when(off & history, F.greatest(p, F.lit(0.5))).when(off, p).otherwise(1.0)},
        "consistency_gate": {"honeypot_gate": F.when(c("honeypot_flag"), p).otherwise(1.0)},
        "availability_floor": {"availability": F.least(F.lit(high), F.greatest(p, p + (high - p) * scoring.engagement(scored)))},
    }
    if model:
        parts["blend"] = {"fit": clamp(p * F.col(model) + (1 - p) * F.col("rubric"))}
    usual = {"fit": fit} | {k: F.col(k) for k in ("availability", "location", "offtarget_gate", "honeypot_gate")}
    points = [(name, i / GRIDS[name][1]) for name in parts for i in GRIDS[name][0]]
    grid = F.broadcast(scored.sparkSession.createDataFrame(points, "parameter string, p double"))  # four short lists
    final = F.coalesce(*(F.when(F.col("parameter") == name, reduce(lambda a, b: a * b, (usual | moved).values())) for name, moved in parts.items()))
    moved = scored.where("tier IS NOT NULL").crossJoin(grid).select(F.struct("parameter", "p").alias("point"), F.col(id_).alias("id"), "tier", F.round(final, 9).alias("moved"))
    return metrics(moved, "point", "moved").select("point.parameter", "point.p", "composite")


def digest(id_: str, seed: int) -> Column:
    """A hash of ids and seed that any engine computes: what samples are drawn by."""
    return F.md5(F.concat(F.col(id_).cast("string"), F.lit(f":{seed}")))


def split(df: DataFrame, id_: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """`df` (unique ids) with the column validation: true for exactly int(n * share) rows, the first by hash."""
    return marked_by_hash(df, int(df.count() * share), digest(id_, seed), F.col(id_), mark="validation")


def sample_with_quotas(df: DataFrame, whole: Column, strata: list[tuple[Column, float]], total: int, id_: str, seed: int = 42) -> DataFrame:
    """Up to `total` rows: those of `whole`, int(total * share) of each stratum, then any others, cut to `total`.

    Strata are conditions and may overlap: a row that several have chosen counts once. Each
    stratum takes its first rows by hash; the rest is filled with the first rows by hash
    that are not taken yet, and if `whole` alone is too large its first `total` rows stay.
    """
    marks, rows = [], df
    for i, (condition, share) in enumerate(strata):  # a row per stratum is broadcast; the table itself stays one scan
        marks.append(f"_in{i}")
        rows = marked_by_hash(rows, {"true": int(total * share)}, digest(id_, seed), F.col(id_), F.coalesce(condition, F.lit(False)).cast("string"), marks[-1], source=df)
    taken = reduce(lambda a, b: a | b, (F.col(m) for m in marks), F.coalesce(whole, F.lit(False)))
    rows = rows.withColumn("_taken", taken.cast("string"))
    sizes = {r["_taken"]: r["n"] for r in rows.groupBy("_taken").agg(F.count("*").alias("n")).collect()}
    picked = min(total, sizes.get("true", 0))
    return first_by_hash(rows, {"true": picked, "false": total - picked}, digest(id_, seed), F.col(id_), F.col("_taken")).select(*df.columns)


def stratified(df: DataFrame, stratum: str, quotas: dict[str, int], id_: str, seed: int = 42) -> DataFrame:
    """Exactly min(quota, size) rows per stratum, the first by hash of id and seed."""
    return first_by_hash(df, quotas, digest(id_, seed), F.col(id_), F.col(stratum))


def histogram(df: DataFrame, value: str, key: str, bins: int = 40, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts in equal bins; the last bin includes its upper end."""
    position = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(key, position.alias("bin")).agg(F.count("*").alias("n"))
