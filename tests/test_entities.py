"""Features, scoring and explanations on hand-made records."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from quillrank.functions.exprs import deduped
from quillrank.functions.policy import DEFAULT
from quillrank.operators import adversarial
from quillrank.operators.audit import timeline_variant
from quillrank.operators.explain import explain
from quillrank.operators.features import enrich, feature_columns, static_features
from quillrank.operators.scoring import rank_top, score
from quillrank.plans.rank import feature_store, rank
from quillrank.sources.entities import numeric_columns, read_entities, read_upload, skipped

# reference date of the default policy: 2026-05-27
STRONG = {
    "candidate_id": "CAND_0000001",
    "profile": {"headline": "Rivers and basins", "summary": "peer review", "location": "Oporto", "country": "Portugal", "current_title": "Catchment Engineer", "years_of_experience": "9.5"},
    "career_history": [
        {"company": "Northwind", "title": "Catchment Engineer", "description": "Runs flood routing in an operational forecast service, 40k gauges.", "start_date": "2022-09-01", "end_date": None, "duration_months": 44.0, "is_current": True},
        {"company": "Fabrikam", "title": "Backend Developer", "description": "Owned billing.", "start_date": "2019-03-15", "end_date": "2022-08-20", "duration_months": 41},
        {"company": "Contoso", "title": "River Engineer", "description": "Weirs.", "start_date": "2016-11-02", "end_date": "2019-02-11", "duration_months": 26},
    ],
    "skills": [
        {"name": "groundwater", "proficiency": "advanced", "endorsements": 12, "duration_months": 70},
        {"name": "sql", "proficiency": "expert", "endorsements": 90, "duration_months": 110},
        {"name": "river gauging by boat", "proficiency": "intermediate", "endorsements": 0, "duration_months": 9},
    ],
    "signals": {"last_active_date": "2026-02-26", "recruiter_response_rate": 0.35, "applications_submitted_30d": 1, "github_activity_score": 22, "notice_period_days": 75, "preferred_work_mode": "onsite", "avg_response_time_hours": 42},
}
MISFIT = {
    "candidate_id": "CAND_0000002",
    "profile": {"location": "Turin", "country": "Italy", "current_title": "Florist", "current_company": "Bright Staff Leasing", "years_of_experience": 4},
    "career_history": [
        {"company": "Bright Staff Leasing", "title": "Florist", "description": "Calls.", "start_date": "2023-06-01", "end_date": None, "duration_months": 35, "is_current": True},
        {"company": "Own shop", "title": "Barista", "description": "Coffee.", "industry": "staff leasing", "start_date": "2022-05-01", "end_date": "2022-06-30", "duration_months": 1},
    ],
    "skills": [{"name": n, "proficiency": "advanced", "endorsements": 3, "duration_months": 1} for n in ("snowmelt", "water balance")] + [{"name": "excel", "proficiency": "expert", "duration_months": 40}],
    "signals": {"skill_assessment_scores": {"snowmelt": 50, "excel": "88"}, "willing_to_relocate": True},
}
BROKEN = {"candidate_id": "CAND_0000003", "profile": {"years_of_experience": 2, "current_title": "Hydrologist"}, "career_history": [{"company": "B", "title": "Hydrologist", "description": "y", "start_date": "2025-01-10", "duration_months": 61, "is_current": True}]}
SCHOLAR = {
    "candidate_id": "CAND_0000005",
    "profile": {"current_title": "Superintendent", "years_of_experience": 0},
    "career_history": [
        {"company": "Uni", "title": "Fellow", "description": "Snowmelt for a dissertation.", "industry": "contract bureau", "start_date": "2018-01-01", "end_date": "2024-01-01", "duration_months": 72},
        {"company": "Uni", "title": "Fellow", "description": "Fieldwork.", "start_date": "2018-02-01", "end_date": "2024-02-01", "duration_months": 72},
    ],
}
EMPTY = {"candidate_id": "CAND_0000004"}


@pytest.fixture(scope="module")
def entities(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("records") / "records.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in (STRONG, MISFIT, BROKEN, EMPTY, SCHOLAR)) + "\n\n")
    return read_entities(spark, str(path))


@pytest.fixture(scope="module")
def features(entities):
    return {r["candidate_id"][-1]: r.asDict() for r in static_features(entities).collect()}


def test_there_are_55_features(spark):
    assert len(feature_columns(DEFAULT)) == 55


def test_strong_record(features):
    f = features["1"]
    used = lambda x, top: math.log(1 + x) / math.log(1 + top)
    assert f["role_target_best"] == f["role_target_current"] == 1 and f["is_offtarget_current"] == 0 and f["ever_built_relevant_flag"] == 1
    assert f["applied_ml_years"] == pytest.approx(70 / 12) and f["applied_ml_fraction"] == pytest.approx(70 / 12 / 9.5)
    assert f["experience_fit"] == pytest.approx(0.15 + 0.85 * math.exp(-(2.5**2) / 18)) and f["avg_tenure_months"] == 37 and f["n_roles"] == 3
    trust = 0.8 * (0.4 + 0.4 * used(70, 120) + 0.2 * used(12, 100)) + 0.5 * (0.4 + 0.4 * used(9, 120))
    assert f["core_skill_hits"] == 2 and f["core_skill_score"] == pytest.approx(trust / 4) and f["scale_signal"] == 1
    # nobody's dates are off by more than 5 months; 9.5 years against a span of 114 months
    assert f["consistency_score"] == 1 and f["honeypot_flag"] == 0
    assert f["response_rate_score"] == pytest.approx(0.4) and f["response_speed_score"] == pytest.approx(0.75) and f["notice_score"] == pytest.approx(0.7)
    assert f["days_since_active"] == 90 and f["recency_score"] == pytest.approx(1 - 0.65 * 60 / 335)
    assert f["offer_acceptance_score"] == 0.5 and f["github_score"] == pytest.approx(0.22) and f["location_tier_score"] == 1 and f["work_mode_fit"] == 0.9


def test_misfit(features):
    f = features["2"]
    assert f["is_offtarget_current"] == 1 and f["role_target_current"] == 0 and f["relevant_history_flag"] == 0
    # 35 of 36 months; an industry is no company
    assert f["services_fraction"] == pytest.approx(35 / 36) and f["all_services_career_flag"] == 1 and f["product_company_flag"] == 1 and f["current_is_services"] == 1
    assert f["skill_claim_inflation"] == 2 and f["assessment_alignment"] == pytest.approx(1 - (0.3 + 0.12) / 2)
    assert f["location_tier_score"] == 0.85 and f["willing_to_relocate_flag"] == 1


def test_broken_timeline(features):
    f = features["3"]
    # 61 months since January 2025, and more than 2 years and a half
    assert f["honeypot_flag"] == 1 and f["n_hard_contradictions"] == 2 and f["consistency_score"] == 0


def test_descriptions_count_and_no_years_mean_no_overlap(features):
    f = features["5"]
    assert f["relevant_history_flag"] == 1 and f["applied_ml_years"] == 6 and f["applied_ml_fraction"] == 0 and f["role_target_current"] == 0.4
    assert f["pure_research_flag"] == 1 and f["no_recent_code_flag"] == 1 and f["services_fraction"] == 0
    assert f["consistency_score"] == 1 and f["years_since_last_relevant"] == pytest.approx(28 / 12)


def test_contradictions_of_a_profile(entities):
    got = {r["candidate_id"][-1]: r["n"] for r in enrich(entities).select("candidate_id", timeline_variant().alias("n")).collect()}
    # with no years of experience every role is longer than the career, unless the years are not known
    assert got == {"1": 0, "2": 0, "3": 2, "4": 0, "5": 2}
    known = enrich(entities).select("candidate_id", timeline_variant(years_given=F.col("candidate_id") != "CAND_0000005").alias("n")).collect()
    assert {r["candidate_id"][-1]: r["n"] for r in known} == got | {"5": 0}


def test_empty_record(features):
    f = features["4"]
    assert (f["recency_score"], f["response_rate_score"], f["response_speed_score"], f["github_score"], f["offer_acceptance_score"]) == (0.5,) * 5
    assert f["interview_completion_score"] == 0 and f["years_since_last_relevant"] == 99 and f["days_since_active"] == -1
    assert f["assessment_alignment"] == 1 and f["consistency_score"] == 1


def test_ranking_and_explanations(entities):
    store = feature_store(entities)
    top = rank_top(score(store), 3)
    rows = explain(top, entities).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and rows[0]["candidate_id"] == "CAND_0000001"
    assert "Catchment Engineer" in rows[0]["reasoning"] and "9.5 yrs" in rows[0]["reasoning"] and "Oporto" in rows[0]["reasoning"]
    again = rank(entities, store.where("candidate_id < 'CAND_0000003'"), n=3).select("candidate_id").collect()
    assert again[0][0] == "CAND_0000001"


def test_lenient_reading(spark, tmp_path):
    path = tmp_path / "mixed.jsonl"
    path.write_text(json.dumps(EMPTY) + "\nnot json\n" + json.dumps(STRONG) + "\n")
    assert read_entities(spark, str(path), mode="skip").count() == 2
    assert tuple(skipped(spark, str(path)).first()) == (2, 1)
    with pytest.raises(Exception, match="malformed"):
        read_entities(spark, str(path)).collect()


def test_uploads(spark, tmp_path):
    texts = {"array": json.dumps([EMPTY, STRONG], indent=1), "object": json.dumps(STRONG, indent=2), "lines": json.dumps(EMPTY) + "\n3\n{broken\n" + json.dumps(STRONG)}
    want = {"array": 2, "object": 1, "lines": 2}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        assert read_upload(spark, str(tmp_path / name)).count() == want[name]
    assert read_upload(spark, str(tmp_path / "array"), cap=1).count() == 1


def test_numeric_columns_and_ordered_values(spark):
    df = spark.createDataFrame([(1, "x", 2.0, [3, 1, 3])], "b int, t string, a double, v array<int>")
    assert numeric_columns(df) == ["a", "b"] and df.select(deduped(F.col("v"))).first()[0] == [3, 1]


def test_array_file_and_key_order(spark, tmp_path):
    path = tmp_path / "array.json"
    path.write_text(json.dumps([dict(reversed(STRONG.items())), EMPTY]))
    got = read_entities(spark, str(path), array=True)
    assert got.count() == 2
    a = static_features(got).where("candidate_id = 'CAND_0000001'").first().asDict()
    assert a["core_skill_hits"] == 2 and a["applied_ml_years"] == pytest.approx(70 / 12)


def test_misleading_records(entities):
    stuffer = static_features(adversarial.stuffed(entities)).first()
    assert stuffer["is_offtarget_current"] == 1 and stuffer["n_roles"] == 0 and stuffer["core_skill_hits"] == len(DEFAULT.core_skills) == stuffer["skill_claim_inflation"]
    wrong = static_features(adversarial.impossible(entities)).first()
    assert wrong["honeypot_flag"] == 1 and wrong["role_target_best"] == 1 and wrong["yoe"] == 3
    away = static_features(adversarial.idle(entities)).first()
    assert away["days_since_active"] == 360 and away["open_to_work_flag"] == 0 and away["response_rate_score"] == pytest.approx(0.1)
    got = adversarial.properties(entities).collect()
    assert len(got) == 5 and all(all(r[1:]) for r in got)
