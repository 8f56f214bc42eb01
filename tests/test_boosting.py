"""Training of ranking trees in Spark against plain gradients and splits by trying all."""

from __future__ import annotations

import numpy as np
import plain_trees
import pytest
from pyspark.sql import functions as F

from quillrank.operators import boosting, evaluate, trees

NAMES = ["a", "b", "c"]


def frame(spark, x, tier):
    return spark.createDataFrame([(i, int(t), *map(float, row)) for i, (row, t) in enumerate(zip(x, tier, strict=True))], "id long, tier int, a double, b double, c double").repartition(3)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, size=(300, 3)).astype(float)
    return x, np.clip(np.round((x[:, 0] + 0.5 * x[:, 1]) / 4 + rng.normal(size=300) * 0.3), 0, 4).astype(int)


@pytest.mark.parametrize("truncation", [300, 20])
def test_gradients(spark, data, truncation):
    tier = data[1]
    rng = np.random.default_rng(1)
    score = np.round(rng.normal(size=300), 3)
    df = spark.createDataFrame([(i, int(t), float(s)) for i, (t, s) in enumerate(zip(tier, score, strict=True))], "id long, tier int, score double").repartition(4)
    gain = np.sort(2.0**tier - 1)[::-1][:50]
    ideal = float((gain / np.log2(np.arange(50) + 2)).sum())
    got = {r["id"]: (r["g"], r["h"]) for r in boosting.gradients(df, truncation, ideal).collect()}
    g, h = plain_trees.lambda_gradients(score, tier, truncation_of_pairs=truncation)
    assert np.array([got[i][0] for i in range(300)]) == pytest.approx(g, abs=1e-9)
    assert np.array([got[i][1] for i in range(300)]) == pytest.approx(h, abs=1e-9)


def test_first_split_is_the_best_of_all(spark, data):
    x, tier = data
    g, h = plain_trees.lambda_gradients(np.zeros(300), tier, truncation_of_pairs=30)
    found = max(((sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (x[:, f] <= t, x[:, f] > t)) - g.sum() ** 2 / (h.sum() + 1), -f, -t) for f in range(3) for t in range(11) if min((x[:, f] <= t).sum(), (x[:, f] > t).sum()) >= 20))
    gain = np.sort(2.0**tier - 1)[::-1]
    scale = float((gain[:50] / np.log2(np.arange(50) + 2)).sum() / (gain[:30] / np.log2(np.arange(30) + 2)).sum())
    model = boosting.train(frame(spark, x, tier), NAMES, rounds=1, rate=1.0, depth=1)[0]
    assert (model["split_feature"], model["threshold"]) == ([-found[1]], [-found[2]]) and scale > 1
    left = x[:, -found[1]] <= -found[2]
    assert model["leaf_count"] == [left.sum(), (~left).sum()]


def test_order_is_learned_and_training_stops(spark, data):
    x, tier = data
    df = evaluate.split(frame(spark, x, tier), "id")
    model = boosting.train(df, NAMES, rounds=8, rate=0.3, depth=2, least=15, validation="validation", patience=2)
    assert 1 <= len(model) <= 8
    scored = df.select("id", "tier", trees.predict_column(NAMES, model).alias("score"))
    assert boosting.ndcg(scored, 10) > boosting.ndcg(scored.withColumn("score", -F.col("score")), 10)
    want = sum(plain_trees.predict(t, x) for t in model)
    got = {r["id"]: r["score"] for r in scored.collect()}
    assert [got[i] for i in range(300)] == pytest.approx(list(want))
    text = trees.format_model(NAMES, model)
    assert trees.parse_model(text) == (NAMES, model)


def test_nothing_to_learn(spark):
    assert boosting.train(frame(spark, np.zeros((50, 3)), np.ones(50)), NAMES, rounds=2) == []
