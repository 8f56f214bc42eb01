"""Rubric, blend, modifiers, gates and the deterministic ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.exprs import clamp, min_max, min_max_stats
from quillrank.functions.policy import DEFAULT, Policy
from quillrank.sources.store import rank_order, row_numbers


def col(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """A feature, or the default where the frame does not have it; NaN and null are 0."""
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0)) if name in df.columns else F.lit(float(default))


def with_rubric(df: DataFrame, policy: Policy = DEFAULT, stats: DataFrame | None = None) -> DataFrame:
    """Adds `rubric`. Population statistics come from the frame unless a snapshot is given."""
    c = lambda n: col(df, n)
    if stats is None:
        stats = min_max_stats(df, "dense_margin") if "dense_margin" in df.columns else df.agg(F.lit(0.0).alias("dense_margin_low"), F.lit(0.0).alias("dense_margin_high"))
    margin = min_max(c("dense_margin"), F.col("dense_margin_low"), F.col("dense_margin_high"))
    parts = {
        "role": clamp(0.7 * c("role_target_best") + 0.3 * c("ever_built_relevant_flag")),
        "semantic": clamp(0.7 * margin + 0.3 * c("must_have_overlap")),
        "skills": clamp(0.4 * c("core_skill_score") + 0.2 * c("embedding_retrieval_signal") + 0.15 * c("vector_db_signal") + 0.15 * c("nlp_ir_depth") + 0.10 * c("eval_framework_signal")) * (0.6 + 0.4 * c("assessment_alignment")),
        "experience": clamp(0.6 * c("experience_fit") + 0.4 * c("applied_ml_fraction")),
        "production": clamp(0.5 * c("production_signal") + 0.3 * c("scale_signal") + 0.2 * c("ever_built_relevant_flag")),
        "company": clamp(1 - c("services_fraction")),
    }
    flags = {"services": "all_services_career_flag", "vision": "cv_dominant_flag", "wrapper": "langchain_only_recent_flag", "research": "pure_research_flag", "no_code": "no_recent_code_flag", "chaser": "tenure_chaser_flag"}
    total = sum(policy.weights.values())
    base = sum((parts[k] * (w / total) for k, w in policy.weights.items()), F.lit(0.0))
    penalty = clamp(sum((c(flags[k]) * w for k, w in policy.penalties.items()), F.lit(0.0)), 0.0, policy.penalty_cap)
    return df.crossJoin(F.broadcast(stats)).withColumn("rubric", clamp(base * (1 - penalty))).drop(*stats.columns)


def blended(df: DataFrame, ranker: Column | None, policy: Policy = DEFAULT, stats: DataFrame | None = None) -> DataFrame:
    """Adds `lgbm` (NaN without a model) and `fit_raw`."""
    if ranker is None:
        return df.withColumn("lgbm", F.lit(float("nan"))).withColumn("fit_raw", F.col("rubric"))
    df = df.withColumn("lgbm", ranker)
    stats = min_max_stats(df, "lgbm") if stats is None else stats
    scaled = min_max(F.col("lgbm"), F.col("lgbm_low"), F.col("lgbm_high"))
    return df.crossJoin(F.broadcast(stats)).withColumn("fit_raw", clamp(policy.blend * scaled + (1 - policy.blend) * F.col("rubric"))).drop(*stats.columns)


def engagement(df: DataFrame) -> Column:
    """Weighted activity, before it is mapped to the availability band."""
    c = lambda n: col(df, n)
    return 0.45 * c("recency_score") + 0.30 * c("response_rate_score") + 0.10 * (0.5 + 0.5 * c("open_to_work_flag")) + 0.08 * c("interview_completion_score") + 0.07 * c("offer_acceptance_score") + 0.05 * c("recruiter_demand_score")


def availability(df: DataFrame, policy: Policy = DEFAULT) -> Column:
    low, high = policy.availability_band
    return clamp(low + (high - low) * engagement(df), low, high)


def location(df: DataFrame, policy: Policy = DEFAULT) -> Column:
    low, high = policy.location_band
    return low + (high - low) * clamp(0.85 * col(df, "location_tier_score") + 0.15 * col(df, "work_mode_fit"))


def off_target_gate(df: DataFrame, policy: Policy = DEFAULT) -> Column:
    off, history, built = (col(df, n) > 0 for n in ("is_offtarget_current", "relevant_history_flag", "ever_built_relevant_flag"))
    g = policy.off_target_gate
    return F.when(off & built, 0.7).when(off & history, max(g, 0.5)).when(off, g).otherwise(1.0)


def consistency_gate(df: DataFrame, policy: Policy = DEFAULT) -> Column:
    return F.when(col(df, "honeypot_flag") > 0, policy.consistency_gate).otherwise(1.0)


def with_modifiers(df: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    gates = {"availability": availability(df, policy), "location": location(df, policy), "offtarget_gate": off_target_gate(df, policy), "honeypot_gate": consistency_gate(df, policy)}
    df = df.withColumns(gates)
    return df.withColumn("final", clamp(F.col("fit_raw")) * F.col("availability") * F.col("location") * F.col("offtarget_gate") * F.col("honeypot_gate"))


def score(features: DataFrame, policy: Policy = DEFAULT, ranker: Column | None = None) -> DataFrame:
    """Features with rubric, lgbm, fit_raw, the modifiers and final."""
    return with_modifiers(blended(with_rubric(features, policy), ranker, policy), policy)


def rank_top(scored: DataFrame, n: int = 100) -> DataFrame:
    """The n best: final descending, NaN last, ties by id; with rank 1..n."""
    return row_numbers(scored.orderBy(*rank_order()).limit(n), *rank_order())
