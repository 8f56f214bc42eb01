"""The 55 static features of an entity, as columns over arrays; no explode, no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.exprs import clamp, gauss, months, num, parse_date, ratio
from quillrank.functions.lexicon import any_of, count_of, seniority
from quillrank.functions.policy import DEFAULT, Policy

# fixed value: what counts as a number that tells of size
SCALE = r"(?iU)\b\d+\s*(million|billion|m\b|b\b|k\b|tb|gb|qps|rps)"
# fixed values: weight of a claimed proficiency
PROFICIENCY = {"beginner": 0.25, "intermediate": 0.5, "advanced": 0.8, "expert": 1.0}


def enrich(df: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Adds `_career` (one struct per role with its flags) and texts, computed once per row."""
    ref = F.to_date(F.lit(policy.reference_date))

    def role(e: Column) -> Column:
        text = F.lower(F.concat_ws(" ", e["title"], e["description"]))
        start, raw_end = parse_date(e["start_date"]), e["end_date"]
        is_open = e["is_current"] | raw_end.isNull()
        end = F.coalesce(parse_date(raw_end), F.when(is_open, ref))
        related = any_of(text, policy.target_titles) | any_of(text, policy.core_skills)
        return F.struct(
            text.alias("text"),
            start.alias("start"),
            end.alias("end"),
            is_open.alias("open"),
            e["duration_months"].alias("months"),
            related.alias("related"),
            (related & any_of(text, policy.production_terms) & any_of(text, policy.core_skills)).alias("built"),
            months(end, ref).alias("gap"),
            any_of(e["company"], policy.services_firms).alias("services"),
            any_of(text, policy.research_terms).alias("research"),
        )

    out = df.withColumn("_career", F.transform("career_history", role))
    skills = F.array_join(F.filter(F.transform("skills", lambda s: s["name"]), lambda n: n != ""), " ")
    career_text = F.array_join(F.transform("_career", lambda e: e["text"]), " ")
    out = out.withColumn("_career_text", career_text)
    return out.withColumn("_text", F.lower(F.concat_ws(" ", F.col("profile.headline"), F.col("profile.summary"), F.col("_career_text"), skills)))


def _sum(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, e: acc + value(e).cast("double"))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def role_features(p: Policy) -> dict[str, Column]:
    title, career = F.col("profile.current_title"), F.col("_career")
    target, off = any_of(title, p.target_titles), any_of(title, p.off_target_titles)
    current = F.when(target, 1.0).when(off, 0.0).otherwise(0.4)
    related = F.exists(career, lambda e: e["related"])
    return {
        "role_target_current": current,
        "role_target_best": F.greatest(current, _flag(related)),
        "relevant_history_flag": _flag(related),
        "ever_built_relevant_flag": _flag(F.exists(career, lambda e: e["built"])),
        "is_offtarget_current": _flag(off),
        "is_manager_current": _flag(any_of(title, p.manager_titles)),
        "title_seniority": seniority(title, p.seniority),
    }


def experience_features(p: Policy) -> dict[str, Column]:
    career, years = F.col("_career"), num(F.col("profile.years_of_experience"))
    count = F.size(career)
    tenure = ratio(_sum(career, lambda e: e["months"]), count)
    applied = _sum(F.filter(career, lambda e: e["related"]), lambda e: e["months"]) / 12
    gaps = F.filter(F.transform(F.filter(career, lambda e: e["related"]), lambda e: e["gap"]), lambda g: g >= 0)
    return {
        "yoe": years,
        "experience_fit": clamp(0.15 + 0.85 * gauss(years, 7.0, 3.0)),
        "applied_ml_years": applied,
        "applied_ml_fraction": F.when(years > 0, clamp(ratio(applied, years))).otherwise(0.0),
        "n_roles": count.cast("double"),
        "avg_tenure_months": tenure,
        "years_since_last_relevant": F.coalesce(F.array_min(gaps) / 12, F.lit(99.0)),
        "tenure_chaser_flag": _flag((count >= 4) & (tenure < 18)),
    }


def skill_features(p: Policy) -> dict[str, Column]:
    text, career_text, skills = F.col("_text"), F.col("_career_text"), F.col("skills")
    weight = lambda s: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PROFICIENCY.items() for x in kv)), s["proficiency"]), F.lit(0.4))
    used = lambda x, top: F.log1p(F.least(x.cast("double"), F.lit(float(top)))) / F.log1p(F.lit(float(top)))
    core = F.filter(skills, lambda s: any_of(s["name"], p.core_skills))
    trust = _sum(core, lambda s: weight(s) * (0.4 + 0.4 * used(s["duration_months"], 120) + 0.2 * used(s["endorsements"], 100)))
    scores = F.col("signals.skill_assessment_scores")
    claimed = F.filter(skills, lambda s: s["proficiency"].isin("advanced", "expert"))
    tested = F.filter(claimed, lambda s: F.map_contains_key(scores, s["name"]))
    over = _sum(tested, lambda s: F.greatest(F.lit(0.0), weight(s) - scores[s["name"]] / 100))
    language, vision = count_of(text, p.language_terms), count_of(text, p.vision_terms)
    embedding = any_of(text, p.embedding_terms)
    return {
        "core_skill_score": clamp(trust / 4),
        "core_skill_hits": F.size(core).cast("double"),
        "assessment_alignment": F.when(F.size(tested) > 0, clamp(1 - ratio(over, F.size(tested)))).otherwise(1.0),
        "skill_claim_inflation": F.size(F.filter(claimed, lambda s: s["duration_months"] <= 1)).cast("double"),
        "vector_db_signal": _flag(any_of(text, p.vector_stores)),
        "embedding_retrieval_signal": _flag(embedding),
        "eval_framework_signal": _flag(any_of(text, p.evaluation_terms)),
        "nlp_ir_depth": clamp(language / 6.0),
        "cv_speech_robotics_dominance": clamp(vision / F.greatest(F.lit(1), language + vision)),
        "cv_dominant_flag": _flag((vision >= 2) & (language <= 1)),
        "langchain_only_recent_flag": _flag(any_of(text, p.wrapper_terms) & ~any_of(text, p.classic_terms) & ~embedding),
        "production_signal": _flag(any_of(career_text, p.production_terms)),
        "scale_signal": _flag(career_text.rlike(SCALE)),
    }


def company_features(p: Policy) -> dict[str, Column]:
    career = F.col("_career")
    total = _sum(career, lambda e: e["months"])
    share = ratio(_sum(F.filter(career, lambda e: e["services"]), lambda e: e["months"]), total)
    return {
        "services_fraction": share,
        "all_services_career_flag": _flag((share >= 0.95) & (total > 0)),
        "product_company_flag": _flag(F.exists(career, lambda e: ~e["services"])),
        "current_is_services": _flag(any_of(F.col("profile.current_company"), p.services_firms)),
    }


def location_features(p: Policy) -> dict[str, Column]:
    place, country = F.lower(F.col("profile.location")), F.lower(F.col("profile.country"))
    near = lambda names: place.rlike("|".join(map(re.escape, names)))
    home, moves = country.contains(p.home_country), F.col("signals.willing_to_relocate")
    base = F.when(near(p.tier1_places), 1.0).when(near(p.tier2_places), 0.85).when(near(p.tier3_places) | home, 0.65).otherwise(0.30)
    mode = F.lower(F.col("signals.preferred_work_mode"))
    return {
        "location_tier_score": F.when((base < 0.85) & moves, F.least(F.lit(0.85), base + 0.15)).otherwise(base),
        "in_india_flag": _flag(home),
        "willing_to_relocate_flag": _flag(moves),
        "work_mode_fit": F.when(mode == "hybrid", 1.0).when(mode == "onsite", 0.9).when(mode == "flexible", 0.95).when(mode == "remote", 0.6).otherwise(0.7),
    }


def recency(days: Column) -> Column:
    """1 up to 30 days, 0.35 from 365 days, a line between; unknown is 0.5."""
    return F.when(days.isNull(), 0.5).when(days <= 30, 1.0).when(days >= 365, 0.35).otherwise(1 - 0.65 * (days - 30) / 335.0)


def neutral_if_negative(x: Column, scale: float = 1.0) -> Column:
    """Sentinels below zero (and null) are 0.5."""
    return F.when(x.isNull() | (x < 0), 0.5).otherwise(clamp(x / scale))


def behaviour_features(p: Policy) -> dict[str, Column]:
    s = lambda name: F.col(f"signals.{name}")
    days = F.datediff(F.to_date(F.lit(p.reference_date)), parse_date(s("last_active_date")))
    rate, hours = num(s("recruiter_response_rate")), num(s("avg_response_time_hours"))
    checks = s("verified_email").cast("int") + s("verified_phone").cast("int") + s("linkedin_connected").cast("int")
    return {
        "days_since_active": F.coalesce(days.cast("double"), F.lit(-1.0)),
        "recency_score": recency(days),
        "response_rate_score": F.when((rate == 0) & (s("applications_submitted_30d") == 0), 0.5).otherwise(clamp(0.05 + rate)),
        "response_speed_score": F.when(hours <= 0, 0.5).otherwise(clamp(1 - hours / 168)),
        "open_to_work_flag": _flag(s("open_to_work_flag")),
        "interview_completion_score": clamp(num(s("interview_completion_rate"))),
        "offer_acceptance_score": neutral_if_negative(s("offer_acceptance_rate")),
        "github_score": neutral_if_negative(s("github_activity_score"), 100.0),
        "recruiter_demand_score": clamp((s("saved_by_recruiters_30d") + 0.2 * s("search_appearance_30d")) / 30),
        "profile_completeness_score": clamp(num(s("profile_completeness_score")) / 100),
        "notice_score": clamp(1 - F.greatest(F.lit(0), s("notice_period_days") - 30) / 150.0),
        "verification_score": checks / 3.0,
    }


def timeline(p: Policy, role_limit: int = 9, open_limit: int = 9) -> tuple[Column, Column]:
    """(hard, soft) contradictions between dates, durations, education and years of experience."""
    career, years = F.col("_career"), num(F.col("profile.years_of_experience"))
    ref = F.to_date(F.lit(p.reference_date))

    def gap(e):
        return months(e["start"], e["end"])

    def off(e):
        return F.when(e["open"], e["months"] - gap(e)).otherwise(F.abs(gap(e) - e["months"]))

    def limit(e):
        return F.when(e["open"], F.lit(open_limit)).otherwise(F.lit(role_limit))

    dated = F.filter(career, lambda e: gap(e) >= 0)
    hard = F.size(F.filter(dated, lambda e: off(e) > limit(e))) + F.size(F.filter(career, lambda e: (years > 0) & (e["months"] > 12 * years + 6)))
    soft = 0.3 * F.size(F.filter(dated, lambda e: (off(e) <= limit(e)) & (off(e) > 5)))
    first = F.array_min(F.transform(career, lambda e: e["start"]))
    span = months(first, F.array_max(F.transform(career, lambda e: e["end"])))
    ends = F.filter(F.transform("education", lambda e: e["end_year"]), lambda y: y.isNotNull() & (y != 0))
    supported = F.coalesce((F.year(ref) - F.array_min(ends)) + 1 >= years, F.lit(False))
    too_short = lambda room: F.coalesce((span / 12.0 + room < years) & ~supported, F.lit(False))
    graduate = (years >= 5) & (F.array_max(ends) >= F.year(ref) - 1) & (F.array_max(ends) - F.year(first) > 4)
    inflated = F.size(F.filter("skills", lambda s: s["proficiency"].isin("advanced", "expert") & (s["duration_months"] <= 1))) >= 5
    total = _sum(career, lambda e: e["months"])
    hard = hard + too_short(1.5).cast("int") + F.coalesce(graduate, F.lit(False)).cast("int")
    soft = soft + 0.3 * (too_short(0.75) & ~too_short(1.5)).cast("int") + 0.3 * F.coalesce((years > 0) & (total > 1.6 * span + 12), F.lit(False)).cast("int") + 0.3 * inflated.cast("int")
    return hard, soft


def consistency_features(p: Policy) -> dict[str, Column]:
    hard, soft = timeline(p)
    return {"consistency_score": clamp(1 - clamp(0.5 * hard + soft)), "honeypot_flag": _flag(hard >= 1), "n_hard_contradictions": hard.cast("double")}


def pattern_features(p: Policy) -> dict[str, Column]:
    career = F.col("_career")
    research = ratio(F.size(F.filter(career, lambda e: e["research"])), F.greatest(F.lit(1), F.size(career)))
    recent = F.exists(career, lambda e: e["related"] & (e["gap"] <= 18))
    return {
        "pure_research_flag": _flag((research >= 0.6) & ~any_of(F.col("_career_text"), p.production_terms)),
        "no_recent_code_flag": _flag(any_of(F.col("profile.current_title"), p.manager_titles) & ~F.coalesce(recent, F.lit(False))),
    }


def must_have_features(p: Policy) -> dict[str, Column]:
    present = sum((any_of(F.col("_text"), g).cast("int") for g in p.must_have), F.lit(0))
    return {"must_have_overlap": present / float(len(p.must_have)), "must_have_count": present.cast("double")}


MODULES = (role_features, experience_features, skill_features, company_features, location_features, behaviour_features, consistency_features, pattern_features, must_have_features)


def feature_columns(policy: Policy = DEFAULT) -> dict[str, Column]:
    return {name: c for module in MODULES for name, c in module(policy).items()}


def static_features(entities: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """candidate_id and the 55 features, all double; runs on batch and streaming frames alike."""
    rich = enrich(entities, policy)
    return rich.select("candidate_id", *(c.cast("double").alias(n) for n, c in feature_columns(policy).items()))


def consistency_reasons(policy: Policy = DEFAULT) -> Column:
    hard, soft = timeline(policy)
    return F.filter(F.array(F.when(hard > 0, F.concat(hard.cast("string"), F.lit(" hard contradictions"))), F.when(soft > 0, F.lit("soft timeline doubts"))), lambda x: x.isNotNull())


def entity_text(weight: int = 2) -> Column:
    """Text for an encoder: title, headline, summary, the career `weight` times, skills."""
    p = F.col("profile")
    career = F.array_join(F.transform("career_history", lambda e: F.concat_ws(" ", e["title"], e["description"])), " ")
    skills = F.array_join(F.filter(F.transform("skills", lambda s: s["name"]), lambda n: n != ""), " ")
    head = F.concat(p["current_title"], F.lit(". "), p["headline"], F.lit(". "), p["summary"])
    return F.trim(F.concat_ws(" ", head, *[career] * weight, skills))
