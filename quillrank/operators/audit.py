"""Profiles, audits and label preparation: grouped aggregates, one pass each."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.exprs import months, num
from quillrank.functions.policy import DEFAULT, Policy
from quillrank.operators.evaluate import histogram
from quillrank.operators.ranges import percentiles


def describe(df: DataFrame, *names: str) -> DataFrame:
    """One row per column: count, mean, sample deviation, min, exact quartiles, max."""
    parts = ", ".join(f"'{n}', cast(`{n}` as double)" for n in names)
    long = df.select(F.expr(f"stack({len(names)}, {parts}) as (name, value)")).where("value IS NOT NULL")
    plain = long.groupBy("name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    return plain.join(percentiles(long, "value", "name", {"q1": 0.25, "q2": 0.5, "q3": 0.75}), "name").select("name", "n", "mean", "std", "low", "q1", "q2", "q3", "high")


def shares(df: DataFrame, group: str, flags: dict[str, Column]) -> DataFrame:
    """Rows and percentages (one decimal) with each flag, per group."""
    return df.groupBy(group).agg(F.count("*").alias("n"), *(F.round(100.0 * F.count_if(c) / F.count("*"), 1).alias(k) for k, c in flags.items()))


def fairness(scored: DataFrame, group: str, n: int, *order: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups among the n best, score histogram per group, ranges of the modifiers)."""
    top = scored.orderBy(*order).limit(n).groupBy(group).agg(F.count("*").alias("n"))
    ranges = scored.agg(*(f(c).alias(f"{c}_{name}") for c in ("availability", "location") for name, f in (("low", F.min), ("high", F.max), ("mean", F.avg))))
    return top, histogram(scored, "final", group), ranges


def movers(ranked: DataFrame, delta: str, key: str, n: int = 3) -> DataFrame:
    """moved (up or down), key and delta of the n rows at either end of `delta`; ties by key."""
    ends = {"up": F.col(delta).desc(), "down": F.col(delta).asc()}
    up, down = (ranked.orderBy(order, key).limit(n).select(F.lit(name).alias("moved"), key, delta) for name, order in ends.items())
    return up.unionByName(down)


def profile(df: DataFrame, flags: dict[str, Column], groups: list[str]) -> DataFrame:
    """dimension, value, measure, n, hits, pct: each flag over all rows ("all", null) and by each of `groups`, in one pass.

    A row adds to one partial sum per dimension; measures are unpivoted from the sums.
    """
    marked = df.select(*groups, *(F.coalesce(c, F.lit(False)).cast("long").alias(f"_{name}") for name, c in flags.items()))
    sums = [F.count("*").alias("n"), *(F.sum(f"_{name}").alias(f"_hits_{name}") for name in flags)]
    grouped = marked.groupingSets([[], *([F.col(g)] for g in groups)], *(F.col(g) for g in groups)).agg(F.grouping_id().alias("_set"), *sums)
    # the bit of a grouped column is 0, the first column has the highest bit
    every = (1 << len(groups)) - 1
    bits = {g: every - (1 << (len(groups) - 1 - i)) for i, g in enumerate(groups)}
    dimension = F.coalesce(*(F.when(F.col("_set") == bit, F.lit(g)) for g, bit in bits.items()), F.lit("all"))
    value = F.coalesce(*(F.when(F.col("_set") == bit, F.col(g).cast("string")) for g, bit in bits.items()))
    measures = F.explode(F.array(*(F.struct(F.lit(name).alias("measure"), F.col(f"_hits_{name}").alias("hits")) for name in flags))).alias("m")
    rows = grouped.select(dimension.alias("dimension"), value.alias("value"), "n", measures)
    return rows.select("dimension", "value", "m.measure", "n", F.coalesce("m.hits", F.lit(0)).alias("hits"), F.round(100.0 * F.coalesce("m.hits", F.lit(0)) / F.col("n"), 1).alias("pct"))


def newest(df: DataFrame, dates: Column) -> DataFrame:
    """One row: the latest date, the reference for ages in a profile of the data."""
    return df.agg(F.max(dates).alias("reference"))


def timeline_variant(policy: Policy = DEFAULT, years_given: Column | None = None) -> Column:
    """Number of contradictions by the rules of a data profile, over enriched records (features.enrich).

    They differ from those of the features: four inflated skills, nine months of tolerance
    whichever way a role's dates and duration differ, two and a half years between the
    claimed experience and the span, and no education that could explain it. Records
    whose years are not given (`years_given` false; without it, all are) pass the rules on years.
    """
    given = F.lit(True) if years_given is None else years_given
    career, years = F.col("_career"), num(F.col("profile.years_of_experience"))
    ref = F.to_date(F.lit(policy.reference_date))
    ends = F.transform(career, lambda e: F.coalesce(e["end"], ref))
    gaps = F.zip_with(career, ends, lambda e, end: F.abs(months(e["start"], end) - e["months"]))
    inflated = F.size(F.filter("skills", lambda s: s["proficiency"].isin("advanced", "expert") & (s["duration_months"] <= 1))) >= 4
    first = F.array_min(F.transform(career, lambda e: e["start"]))
    span = months(first, F.array_max(ends)) / 12.0
    last = F.array_max(F.filter(F.transform("education", lambda e: e["end_year"]), lambda y: y.isNotNull() & (y != 0)))
    graduate = (years >= 5) & (last - F.year(first) > 4) & (last >= F.year(ref) - 2)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    roles = F.size(F.filter(gaps, lambda g: g > 9)) + F.size(F.filter(career, lambda e: given & (e["months"] > 12 * years + 6)))
    return flag(inflated) + roles + flag(given & (span + 0.5 < years - 2)) + flag(given & graduate)


def tiers_for_training(labels: DataFrame, features: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Labels joined with features; contradictory records count as tier 0."""
    flag = F.coalesce(F.col("honeypot_flag"), F.lit(0.0)) > 0
    return labels.join(features, key).withColumn("tier", F.when(flag, 0).otherwise(F.col("tier")))


def write_summary(row: DataFrame, path: str) -> None:
    """A one-row summary as a JSON file."""
    row.limit(1).coalesce(1).write.mode("overwrite").json(path)


def as_json(row: DataFrame) -> str:
    """A one-row summary as JSON text on the driver."""
    return json.dumps(json.loads(row.toJSON().first() or "{}"), sort_keys=True)


def interval_table(ci: list[dict]) -> str:
    """Markdown of variants with mean and interval."""
    lines = ["| variant | mean | 95 % interval |", "|---|---|---|"]
    return "\n".join(lines + [f"| {r['variant']} | {r['mean']:.4f} | {r['low']:.4f}-{r['high']:.4f} |" for r in ci])
