"""The two batch plans: build the feature store, and rank from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.policy import DEFAULT, Policy
from quillrank.operators.explain import explain
from quillrank.operators.features import entity_text, static_features
from quillrank.operators.retrieval import bm25
from quillrank.operators.scoring import rank_top, score


def feature_store(entities: DataFrame, policy: Policy = DEFAULT, dense: DataFrame | None = None) -> DataFrame:
    """Static features, BM25 against the policy's query and (candidate_id, dense_*) where vectors are given."""
    texts = entities.select("candidate_id", entity_text().alias("text"))
    out = static_features(entities, policy).join(bm25(texts, "candidate_id", "text", policy.query.split()), "candidate_id", "left")
    return out.join(dense, "candidate_id", "left") if dense is not None else out


def rank(entities: DataFrame, store: DataFrame, policy: Policy = DEFAULT, ranker: Column | None = None, n: int = 100) -> DataFrame:
    """Rank the given entities: stored features where there are some, live ones for the rest."""
    ids = entities.select("candidate_id")
    cached = store.join(ids, "candidate_id", "left_semi")
    missing = entities.join(store.select("candidate_id"), "candidate_id", "left_anti")
    live = feature_store(missing, policy)
    features = cached.unionByName(live, allowMissingColumns=True)
    return explain(rank_top(score(features, policy, ranker), n), entities).orderBy(F.col("rank"))
