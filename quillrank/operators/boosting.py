"""Gradient-boosted trees for ranking, grown by Spark jobs over all labelled rows.

Features are binned once. Each round numbers the rows by score (in ranges), computes the
pairwise gradients of NDCG for pairs with one of the `truncation` best rows, and grows a
tree level by level: sums of gradients per (node, feature, bin) are one aggregate, from
which the best split of each node is chosen. What reaches the driver are the best rows of
a ranking, a split per node and the cuts of the bins; none of it grows with the rows.
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.operators.ranges import running
from quillrank.operators.trees import Tree
from quillrank.sources.tables import discard, stored

BINS = 64
STORE_EVERY = 8  # trees after which scores are written anew instead of computed from the trees


def cuts_of(df: DataFrame, names: list[str], bins: int = BINS) -> list[list[float]]:
    """Up to bins - 1 cuts per feature: quantiles, or every value where there are few."""
    value = lambda n: F.coalesce(F.nanvl(F.col(n).cast("float").cast("double"), F.lit(0.0)), F.lit(0.0))
    points = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    row = df.agg(*(F.array_sort(F.array_distinct(F.percentile_approx(value(n), points, F.lit(100 * bins)))).alias(f"c{i}") for i, n in enumerate(names))).first()
    return [list(c or []) for c in row]


def binned(df: DataFrame, names: list[str], cuts: list[list[float]]) -> Column:
    """Per feature the number of cuts below the value: value <= cuts[b] if the bin is at most b."""
    value = lambda n: F.coalesce(F.nanvl(F.col(n).cast("float").cast("double"), F.lit(0.0)), F.lit(0.0))
    below = lambda n, c: F.size(F.filter(F.array(*map(F.lit, c)).cast("array<double>"), lambda x: x < value(n))) if c else F.lit(0)
    return F.array(*(below(n, c).cast("short") for n, c in zip(names, cuts, strict=True)))


def gradients(scored: DataFrame, truncation: int, ideal: float) -> DataFrame:
    """`scored` (id, tier, score, ...) with g and h: slope and curvature of pairs in which one row is among the best `truncation`."""
    placed = running(scored, [], [F.col("score").desc(), F.col("id")], "pos")
    best = placed.where(F.col("pos") <= truncation).select("pos", "score", "tier").orderBy("pos").collect()
    if not best:
        return placed.withColumn("g", F.lit(0.0)).withColumn("h", F.lit(0.0))
    top = F.array(*(F.struct(F.lit(float(r["pos"])).alias("pos"), F.lit(float(r["score"])).alias("score"), F.lit(float(r["tier"])).alias("tier")) for r in best))
    gain = lambda t: F.pow(F.lit(2.0), t) - 1
    discount = lambda p: 1 / F.log2(p + 1.0)
    tier, score, pos = F.col("tier").cast("double"), F.col("score"), F.col("pos").cast("double")

    def pair(o: Column) -> Column:
        """What the row gets from its pair with o: (slope, curvature); o gets (-slope, curvature)."""
        delta = F.abs((gain(o["tier"]) - gain(tier)) * (discount(o["pos"]) - discount(pos))) / ideal
        lead = F.when(tier > o["tier"], score - o["score"]).otherwise(o["score"] - score)
        rho = 1 / (1 + F.exp(F.least(F.lit(50.0), F.greatest(F.lit(-50.0), lead))))
        some = (tier != o["tier"]) & (pos != o["pos"])
        slope = F.when(tier > o["tier"], rho * delta).otherwise(-rho * delta)
        return F.struct(F.when(some, slope).otherwise(0.0).alias("g"), F.when(some, rho * (1 - rho) * delta).otherwise(0.0).alias("h"))

    paired = placed.withColumn("_pairs", F.transform(top, pair))
    # the best rows also have pairs with all others: summed where those are
    rest = paired.where(F.col("pos") > truncation).select(F.posexplode("_pairs").alias("i", "p")).groupBy("i").agg(F.sum("p.g").alias("g"), F.sum("p.h").alias("h")).collect()  # a row per best row
    sums = {r["i"]: (-r["g"], r["h"]) for r in rest}
    extra = lambda k: F.coalesce(F.get(F.array(*(F.lit(sums.get(i, (0.0, 0.0))[k]) for i in range(len(best)))), (F.col("pos") - 1).cast("int")), F.lit(0.0))
    total = lambda k: F.aggregate("_pairs", F.lit(0.0), lambda s, p: s + p[k])
    return paired.withColumn("g", total("g") + extra(0)).withColumn("h", total("h") + extra(1)).drop("_pairs")


def _node(tree: dict, at: int) -> Column:
    """The number of the open or closed leaf of a row, by the splits so far."""
    if at not in tree:
        return F.lit(at)
    f, b, left, right = tree[at][:4]
    return F.when(F.col("x")[f] <= b, _node(tree, left)).otherwise(_node(tree, right))


def best_splits(rows: DataFrame, least: int, l2: float) -> DataFrame:
    """node, f, b, gain, n, left_n: the best split of each node of `rows` (node, x, g, h)."""
    long = rows.select("node", "g", "h", F.posexplode("x").alias("f", "b"))
    sums = long.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))  # nodes * features * bins rows
    up = Window.partitionBy("node", "f").orderBy("b")
    every = Window.partitionBy("node", "f")
    told = sums.select("node", "f", "b", *(F.sum(c).over(up).alias(f"l{c}") for c in "ghn"), *(F.sum(c).over(every).alias(f"t{c}") for c in "ghn"))
    part = lambda g, h: g * g / (h + l2)
    gain = part(F.col("lg"), F.col("lh")) + part(F.col("tg") - F.col("lg"), F.col("th") - F.col("lh")) - part(F.col("tg"), F.col("th"))
    ok = told.withColumn("gain", gain).where((F.col("ln") >= least) & (F.col("tn") - F.col("ln") >= least) & (F.col("gain") > 1e-12))
    choice = F.max_by(F.struct("f", "b", "gain", "tn", "ln"), F.struct(F.round("gain", 12), -F.col("f"), -F.col("b"))).alias("s")
    return ok.groupBy("node").agg(choice).select("node", "s.f", "s.b", "s.gain", F.col("s.tn").alias("n"), F.col("s.ln").alias("left_n"))


def grow(rows: DataFrame, cuts: list[list[float]], depth: int, least: int, l2: float, rate: float) -> tuple[Tree, dict, dict[int, float]]:
    """(the tree as text models have it, its splits by node, value of each leaf node) from `rows` (x, g, h)."""
    splits: dict[int, tuple] = {}
    open_, free = {0}, 1
    for _ in range(depth):
        level = rows.withColumn("node", _node(splits, 0)).where(F.col("node").isin(sorted(open_)))
        found = {r["node"]: r for r in best_splits(level, least, l2).collect()}  # a row per open node
        open_ = set()
        for node, r in sorted(found.items()):
            splits[node] = (r["f"], r["b"], free, free + 1, r["gain"], float(r["n"]))
            open_ |= {free, free + 1}
            free += 2
        if not open_:
            break
    leaves = rows.groupBy(_node(splits, 0).alias("node")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect()  # a row per leaf
    value = {r["node"]: (rate * r["g"] / (r["h"] + l2), float(r["n"])) for r in leaves}
    inner = {node: i for i, node in enumerate(sorted(splits))}
    outer = {node: i for i, node in enumerate(sorted(value))}
    child = lambda node: inner[node] if node in inner else ~outer[node]
    ordered = [splits[node] for node in sorted(splits)]
    tree: Tree = {
        "split_feature": [s[0] for s in ordered], "threshold": [cuts[s[0]][s[1]] for s in ordered], "left_child": [child(s[2]) for s in ordered], "right_child": [child(s[3]) for s in ordered],
        "split_gain": [s[4] for s in ordered], "internal_count": [s[5] for s in ordered], "leaf_value": [value[n][0] for n in sorted(value)], "leaf_count": [value[n][1] for n in sorted(value)],
    }
    return tree, splits, {n: v for n, (v, _) in value.items()}


def _leaf(splits: dict, values: dict[int, float], at: int = 0) -> Column:
    if at not in splits:
        return F.lit(values.get(at, 0.0))
    f, b, left, right = splits[at][:4]
    return F.when(F.col("x")[f] <= b, _leaf(splits, values, left)).otherwise(_leaf(splits, values, right))


def ndcg(scored: DataFrame, k: int) -> float:
    """NDCG at k of one query group (id, tier, score); 0 without a relevant row. Two times k rows reach the driver."""
    gains = lambda rows: sum((2.0 ** r["tier"] - 1) / log2(i + 2) for i, r in enumerate(rows))
    best = gains(scored.orderBy(F.desc("tier"), "id").limit(k).select("tier").collect())
    return gains(scored.orderBy(F.desc("score"), "id").limit(k).select("tier").collect()) / best if best else 0.0


def train(df: DataFrame, names: list[str], rounds: int = 60, rate: float = 0.05, depth: int = 5, least: int = 20, l2: float = 1.0, truncation: int = 30, validation: str | None = None, patience: int = 50, bins: int = BINS) -> list[Tree]:
    """Trees whose summed leaves rank `df` (id, tier, features `names`) as one query group.

    Rows where the column `validation` is true do not train; with it, training stops when
    NDCG@10 there has not risen for `patience` rounds, and the trees up to the best round
    stay. Null and NaN features are 0.
    """
    cuts = cuts_of(df, names, bins)
    held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    base = stored(df.select("id", F.col("tier").cast("int").alias("tier"), held.alias("held"), binned(df, names, cuts).alias("x"), F.lit(0.0).alias("score")), "boost")
    top = base.where("NOT held").orderBy(F.desc("tier")).limit(truncation).select("tier").collect()
    ideal = sum((2.0 ** r["tier"] - 1) / log2(i + 2) for i, r in enumerate(top)) or 1.0
    trees: list[Tree] = []
    pending: list[Column] = []
    best, best_round = -1.0, 0
    for _ in range(rounds):
        scored = base.withColumn("score", reduce(lambda a, b: a + b, pending, F.col("score")))
        rows = stored(gradients(scored.where("NOT held").select("id", "tier", "score", "x"), truncation, ideal).select("x", "g", "h"), "boost-gradients")
        tree, splits, values = grow(rows, cuts, depth, least, l2, rate)
        discard(rows)
        if not splits:
            break
        trees.append(tree)
        pending.append(_leaf(splits, values))
        now = base.withColumn("score", reduce(lambda a, b: a + b, pending, F.col("score")))
        if len(pending) >= STORE_EVERY:
            before, base = base, stored(now, "boost")
            discard(before)
            pending, now = [], base
        if validation:
            reached = ndcg(now.where("held"), 10)
            if reached > best:
                best, best_round = reached, len(trees)
            elif len(trees) - best_round >= patience:
                break
    return trees[:best_round] if validation and trees else trees
