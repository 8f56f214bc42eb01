"""Live scoring: uploads with their own statistics, restarts, batches that run twice, bounded state; the stored index."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillrank.operators import postings, retrieval
from quillrank.plans.rank import feature_store
from quillrank.sources.entities import raw_schema, read_entities, typed
from quillrank.streaming import live


def records(spark, ids):
    rows = [(f"P{i}", f"{'river' if i % 2 else 'ledger'} engineer", f"discharge {'telemetry ' * (i % 4)}work {i}") for i in ids]
    raw = spark.createDataFrame(rows, "id string, title string, text string")
    record = F.struct(F.col("id").alias("candidate_id"), F.struct(F.col("title").alias("current_title"), F.col("text").alias("summary")).alias("profile"))
    return raw.select(F.to_json(record).alias("value"))


def test_uploads_restart_and_run_twice(spark, tmp_path):
    path = str(tmp_path)
    uploads = [range(0, 20), range(20, 27), range(27, 60)]
    stats = spark.createDataFrame([(0.0, 1.0)], "dense_margin_low double, dense_margin_high double")
    for n, ids in enumerate(uploads):
        records(spark, ids).write.mode("append").text(f"{path}/in")
        stream = live.entity_stream(spark, f"{path}/in")
        live.run_available(stream, live.live_features, f"{path}/features", f"{path}/c1")
        live.run_available(live.score_stream(stream, stats), lambda b: b, f"{path}/scores", f"{path}/c2")
        if n == 1:  # as if the run had ended between the write and the commit of its batch
            last = max(Path(f"{path}/c1/commits").glob("[0-9]*"), key=lambda p: int(p.name))
            last.unlink()
            last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    got = live.kept(spark, f"{path}/features")
    assert got.count() == got.select("candidate_id").distinct().count() == 60
    found = {r["candidate_id"]: r["bm25"] for r in got.collect()}
    for n, ids in enumerate(uploads):
        own = feature_store(typed(records(spark, ids).select(F.from_json("value", raw_schema()).alias("r")).select("r.*")))
        for r in own.collect():
            assert found[r["candidate_id"]] == pytest.approx(r["bm25"]), n
    batch = live.score_stream(read_entities(spark, f"{path}/in"), stats)
    scored = {r["candidate_id"]: r["final"] for r in live.kept(spark, f"{path}/scores").collect()}
    assert scored == {r["candidate_id"]: r["final"] for r in batch.collect()} and len(scored) == 60


def test_nothing_is_kept_before_the_first_batch(spark, tmp_path):
    assert live.kept(spark, f"{tmp_path}/none") is None


def test_state_is_dropped_behind_the_watermark(spark, tmp_path):
    path = str(tmp_path)
    days = [("a", 1, "2024-01-01 10:00:00"), ("b", 2, "2024-01-01 11:00:00")], [("a", 3, "2024-01-09 10:00:00")], [("a", 9, "2024-01-01 12:00:00"), ("b", 4, "2024-01-09 09:00:00")]
    sizes = []
    for rows in days:
        spark.createDataFrame(rows, "k string, n int, ts string").write.mode("append").json(f"{path}/in")
        stream = spark.readStream.schema("k string, n int, ts timestamp").json(f"{path}/in")
        query = live.latest_stream(stream, "k", "ts", ["ts", "n"]).writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/out/batch={i}")).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {r["k"]: r["n"] for r in live.latest_kept(live.kept(spark, f"{path}/out"), "k", ["ts", "n"]).collect()}
    assert got == {"a": 3, "b": 4}  # the record of the first day that came last is too late
    assert sizes[0] == 2 and max(sizes) == 2


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 3 + i % 57]) for _ in range(rng.randint(0, 40)))) for i in range(700)]
    rows += [(1000, None), (1001, ""), (1002, "w1 w1 w1 w59")]
    return spark.createDataFrame(rows, "id long, text string")


@pytest.mark.parametrize("query", ["w1 w50", "w55 w58 w58 w3", "w0", "absent", "w59 absent w59"])
def test_postings(spark, corpus, tmp_path, query, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    index = postings.build(corpus, "id", "text", f"{tmp_path}/index")
    assert index.postings.agg(F.max(F.size("entries"))).first()[0] <= 16
    whole = {r["id"]: r["bm25"] for r in retrieval.bm25(corpus, "id", "text", query.split()).collect()}
    got = {r["key"]: r["bm25"] for r in postings.scores(index, query.split()).collect()}
    assert got == pytest.approx(whole)
    best = sorted(((-round(v, 6), i) for i, v in whole.items()))[:30]
    assert [(-r["bm25"], r["key"]) for r in postings.top_k(index, query.split(), 30, digits=6).collect()] == best


def test_postings_are_pruned(spark, corpus, tmp_path):
    """The term filter reaches the scan of the stored index."""
    index = postings.build(corpus, "id", "text", f"{tmp_path}/index")
    plan = postings.blocks_of(index, ["w1", "w7"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [w1,w7])" in plan
