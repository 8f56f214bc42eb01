"""What the rounds of review found, in small."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quillrank import queries
from quillrank.operators import evaluate, postings, ranges, retrieval
from quillrank.sources.tables import stored

D = "/root/testdata/sf0.001"


def test_records_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    for name in ("orders", "events"):
        spark.read.parquet(f"{D}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{D}/lineitem.parquet").orderBy("l_partkey", "l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    text = lambda d: {r["id"]: r["record"] for r in queries._records(spark, d).collect()}
    assert text(str(tmp_path)) == text(D)


def test_draws_are_not_stored_and_ties_are_cut(spark, monkeypatch):
    rows = [(i, (i * 7) % 5, 0.0 if i < 30 else float(i % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, tier int, s double")
    drawn = evaluate.resampled(spark, 60, 8).join(df.withColumnRenamed("id", "idx"), "idx").withColumn("id", F.col("draw"))
    want = {r["round"]: r for r in evaluate.metrics(drawn, "round", "s").collect()}
    sizes = []

    def counted(frame, *more):
        out = stored(frame, *more)
        sizes.append(out.count())
        return out

    for module in (evaluate, ranges):
        monkeypatch.setattr(module, "stored", counted)
    evaluate.bootstrap(df, "s", 8).collect()
    assert max(sizes) < 8 * 60
    for range_rows in (4, 7, 1 << 14):
        got = evaluate.resampled_metrics(df, {"a": "s", "b": "s"}, 8, 42, range_rows=range_rows).collect()
        assert len(got) == 16
        for r in got:
            assert all(abs(r[m] - want[r["round"]][m]) < 1e-12 for m in ("ndcg10", "ndcg50", "map", "p5", "p10", "composite"))


def test_hashed_vectors_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, ""), (3, None), (4, "x " * 5000)], "id int, t string")
    vectors = retrieval.hashed(docs, "id", "t", 16)
    assert "Exchange" not in vectors._jdf.queryExecution().executedPlan().toString()
    for r in vectors.join(docs, "id").collect():
        want = [0.0] * 16
        for w in (r["t"] or "").split():
            h = hashlib.md5(w.encode()).hexdigest()
            want[int(h[:8], 16) % 16] += 1 if h[8] < "8" else -1
        norm = sum(x * x for x in want) ** 0.5 or 1.0
        assert all(abs(a - b / norm) < 1e-12 for a, b in zip(r["vector"], want, strict=True))


@pytest.mark.parametrize("name, source", [("misleading_records", "_people"), ("uploads", "_records"), ("sensitivity", "_scored")])
def test_sources_are_computed_once(spark, monkeypatch, name, source):
    seen = spark.sparkContext.accumulator(0)
    plain = getattr(queries, source)

    def watched(*given):
        rows = plain(*given)
        column = "candidate_id" if "candidate_id" in rows.columns else "id"

        @F.udf("boolean")
        def note(_):
            seen.add(1)
            return True

        return rows.where(note.asNondeterministic()(column))  # stays where it is

    want = plain(spark, D).count()
    monkeypatch.setattr(queries, source, watched)
    queries.QUERIES[name](spark, D).collect()
    assert seen.value == want


def test_postings_are_shuffled_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "PART", 16)
    rows = [(i, " ".join(f"w{(i * k) % 13}" for k in range(i % 9))) for i in range(200)] + [(200, None)]
    docs = spark.createDataFrame(rows, "id int, t string")
    index = postings.build(docs, "id", "t", f"{tmp_path}/index")
    want = {(w, i, t.split().count(w), len(t.split())) for i, t in rows if t for w in t.split()}
    got = [tuple(r) for r in index.postings.select("term", F.explode("entries").alias("e")).select("term", "e.key", "e.tf", "e.dl").collect()]
    assert len(got) == len(want) and set(got) == want
    assert index.postings.select("term", "block").distinct().count() == index.postings.count()
    assert index.docs.count() == 201
    assert spark.read.parquet(f"{tmp_path}/index/counts").count() == 201  # a row a document, not a row a word
