"""Properties of scores and audits."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from quillrank.functions.exprs import fixed
from quillrank.operators import audit
from quillrank.operators.scoring import score


def _frame(spark, **more):
    base = {"candidate_id": "a", "role_target_best": 1.0, "recency_score": 0.8, "response_rate_score": 0.7, "location_tier_score": 0.85, "work_mode_fit": 1.0, "dense_margin": 0.1}
    return spark.createDataFrame([{**base, **more}, {**base, "candidate_id": "b", "dense_margin": 0.4}])


def _final(df):
    return df.where("candidate_id = 'a'").first()["final"]


def test_gates_only_lower(spark):
    plain = _final(score(_frame(spark)))
    assert 0 < plain <= 1.05 * 1.04
    assert abs(_final(score(_frame(spark, honeypot_flag=1.0))) - 0.03 * plain) < 1e-9
    assert abs(_final(score(_frame(spark, is_offtarget_current=1.0))) - 0.15 * plain) < 1e-9
    assert _final(score(_frame(spark, all_services_career_flag=1.0))) < plain
    assert _final(score(_frame(spark, recency_score=0.2))) < plain


def test_blend_with_a_model(spark):
    df = score(_frame(spark), ranker=F.when(F.col("candidate_id") == "a", 2.0).otherwise(-1.0))
    r = df.where("candidate_id = 'a'").first()
    assert abs(r["fit_raw"] - (0.6 + 0.4 * r["rubric"])) < 1e-9


def test_missing_columns_and_nan(spark):
    df = spark.createDataFrame([("x", float("nan")), ("y", None)], "candidate_id string, dense_margin double")
    assert all(r["final"] == r["final"] for r in score(df).collect())


def test_summary_json(spark, tmp_path):
    row = audit.newest(spark.createDataFrame([("2024-01-02",), ("2024-03-01",)], "d string"), F.to_date("d"))
    assert json.loads(audit.as_json(row)) == {"reference": "2024-03-01"}
    audit.write_summary(row, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first()["reference"] == "2024-03-01"


def test_contradictions_train_as_zero(spark):
    labels = spark.createDataFrame([("a", 4), ("b", 3)], "candidate_id string, tier int")
    feats = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "candidate_id string, honeypot_flag double")
    assert sorted((r["candidate_id"], r["tier"]) for r in audit.tiers_for_training(labels, feats).collect()) == [("a", 0), ("b", 3)]


def test_numbers_as_python_writes_them(spark):
    """Every double as f"{x:.1f}" has it: ties that are exact, that only look so, and large and small ones."""
    rng = random.Random(9)
    values = [0.0, 0.05, 0.125, 0.25, 0.35, 0.5, 0.95, 1.5, 2.5, 2.25, 2.675, 9.995, 99.95, 7.0, 1e-9, 123456.785, -0.25, -2.5]
    values += [rng.randint(0, 10**5) / 1000 for _ in range(400)] + [rng.randint(0, 4000) / 64 for _ in range(200)] + [rng.random() * 10 ** rng.randint(-3, 9) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    for r in df.select("x", *(fixed(F.col("x"), k).alias(f"d{k}") for k in range(4))).collect():
        assert tuple(r)[1:] == tuple(f"{r['x']:.{k}f}" for k in range(4)), r
