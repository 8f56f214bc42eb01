"""Positions, order statistics and k of n by ranges, against plain Python; one key holds most rows."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillrank.operators import ranges


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [("hot", rng.randint(0, 40) * 0.5, i) for i in range(900)]
    out += [(f"k{i % 5}", float(rng.randint(-9, 9)), 1000 + i) for i in range(60)]
    out += [(None, 3.0, 2000), (None, 1.0, 2001), ("one", 7.25, 3000), ("none", None, 4000)]
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, v double, id long").repartition(5)


def by_key(rows):
    out = {}
    for k, v, i in rows:
        out.setdefault(k, []).append((v, i))
    return out


def test_running_values(df, rows):
    got = ranges.running(df.where("v IS NOT NULL"), ["k"], [F.col("v"), F.col("id")], "pos", {"total": ("sum", "v"), "mixed": ("bit_xor", "id")}).collect()
    assert len(got) == len(rows) - 1
    found = {r["id"]: r for r in got}
    for k, held in by_key(r for r in rows if r[1] is not None).items():
        total = mixed = 0
        for n, (v, i) in enumerate(sorted(held), 1):
            total, mixed = total + v, mixed ^ i
            assert (found[i]["k"], found[i]["pos"], found[i]["total"], found[i]["mixed"]) == (k, n, total, mixed)


@pytest.mark.parametrize("cuts", [256, 4])
def test_ranks(df, rows, cuts, monkeypatch):
    monkeypatch.setattr(ranges, "CUTS", cuts)
    for q in (0.0, 0.5, 0.9, 1.0):
        got = {r["k"]: r["pct"] for r in ranges.nearest_rank(df, "v", q, "k").collect()}
        for k, held in by_key(r for r in rows if r[1] is not None).items():
            values = sorted(v for v, _ in held)
            assert got.pop(k) == values[round(q * (len(values) - 1))]
        assert not got
    wide = df.withColumn("v", F.col("v") + F.col("id") / 7919)
    got = {r["k"]: r for r in ranges.percentiles(wide, "v", "k", {"med": 0.5, "p90": 0.9}).collect()}
    plain = {r["k"]: r for r in wide.groupBy("k").agg(F.median("v").alias("med"), F.expr("percentile(v, 0.9)").alias("p90")).where("med IS NOT NULL").collect()}
    assert got.keys() == plain.keys()
    for k, r in plain.items():
        assert got[k]["med"] == pytest.approx(r["med"], abs=1e-9) and got[k]["p90"] == pytest.approx(r["p90"], abs=1e-9)


def test_ranks_of_nothing(df):
    assert ranges.nearest_rank(df.where("k = 'none'"), "v", 0.5, "k").count() == 0
    assert ranges.percentiles(df.limit(0), "v", "k", {"med": 0.5}).count() == 0


@pytest.mark.parametrize("digits", [1, 4])
def test_first_by_hash(df, rows, digits):
    digest = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    column = F.md5(F.col("id").cast("string"))
    for k in (0, 1, 333, 5000):
        got = sorted(r["id"] for r in ranges.first_by_hash(df, k, column, F.col("id"), digits=digits).collect())
        assert got == sorted(sorted((i for _, _, i in rows), key=digest)[:k])
    got = ranges.first_by_hash(df, {"hot": 100, "k1": 3, "one": 9}, column, F.col("id"), F.col("k"), digits=digits).collect()
    want = [i for k, n in (("hot", 100), ("k1", 3), ("one", 9)) for i in sorted((i for key, _, i in rows if key == k), key=digest)[:n]]
    assert sorted(r["id"] for r in got) == sorted(want)


def test_no_task_takes_a_whole_key(df):
    """No limit of k rows, and what is ordered are the rows of one prefix only."""
    chosen = ranges.first_by_hash(df, 500, F.md5(F.col("id").cast("string")), F.col("id"))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert plan.count("row_number") == 1 and plan.count("SortMergeJoin") == 0
