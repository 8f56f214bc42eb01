"""Metrics, trees, labelling and sinks against values worked out by hand."""

from __future__ import annotations

import json
import math
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_trees
from quillrank.functions import rewrite
from quillrank.operators import audit, evaluate, labeling, trees
from quillrank.queries import MODEL
from quillrank.sources import store, vectors

TIERS = {"p": 1, "q": 3, "r": 2, "s": 0, "t": 4, "u": 3, "v": 0}


def _metrics(spark, order):
    rows = [("k", x, TIERS[x], float(len(order) - i)) for i, x in enumerate(order)]
    return evaluate.metrics(spark.createDataFrame(rows, "k string, id string, tier int, score double"), "k", "score").first()


def _plain(order):
    """NDCG, average precision and precision at 5 by their definitions."""
    gains = [2.0 ** TIERS[x] - 1 for x in order]
    dcg = lambda g: sum(x / math.log2(i + 2) for i, x in enumerate(g))
    hits = [TIERS[x] >= 3 for x in order]
    average = sum(sum(hits[: i + 1]) / (i + 1) for i, h in enumerate(hits) if h) / sum(hits)
    return dcg(gains) / dcg(sorted(gains, reverse=True)), average, sum(hits[:5]) / 5


@pytest.mark.parametrize("order", ["tqurpsv", "vspruqt", "utspqvr", "rqvtpsu"])
def test_metrics(spark, order):
    m = _metrics(spark, order)
    assert (m["ndcg10"], m["map"], m["p5"]) == pytest.approx(_plain(order))
    assert (m["ndcg10"] == pytest.approx(1)) == (order == "tqurpsv")


def test_bootstrap_draws_with_replacement(spark):
    n, rounds = 60, 25
    df = spark.createDataFrame([(i, i * 7 % 5, float(i * 11 % 17)) for i in range(n)], "id long, tier int, score double")
    drawn = {(r["round"], r["draw"]): r["idx"] for r in evaluate.resampled(spark, n, rounds).collect()}
    assert drawn == {(b, i): int(md5(f"{b}:{i}:42".encode()).hexdigest()[:15], 16) % n for b in range(rounds) for i in range(n)}
    different = [len({drawn[b, i] for i in range(n)}) for b in range(rounds)]
    assert max(different) < n and 0.55 < sum(different) / (n * rounds) < 0.72
    out = evaluate.bootstrap(df, "score", rounds).first()
    assert out["std"] > 0.01 and out["low"] < out["mean"] < out["high"]


def test_variants_are_resampled_together(spark):
    df = spark.createDataFrame([(i, i * 7 % 5, float(i * 11 % 17), float(-(i * 11 % 17))) for i in range(40)], "id long, tier int, up double, down double")
    got = {r["variant"]: r for r in evaluate.bootstrap_variants(df, {"up": "up", "again": "up", "down": "down"}, 20).collect()}
    one = evaluate.bootstrap(df, "up", 20).first()
    assert [got["up"][c] for c in ("mean", "std", "low", "high")] == pytest.approx([one[c] for c in ("mean", "std", "low", "high")])
    assert got["up"][1:] == got["again"][1:] != got["down"][1:]
    table = audit.interval_table([r.asDict() for r in got.values()])
    assert table.count("\n") == 4 and f"| up | {one['mean']:.4f} |" in table


def test_no_relevant_row(spark):
    df = spark.createDataFrame([("k", "m", 0, 7.0), ("k", "n", 2, 5.0), ("k", "o", 0, 1.0)], "k string, id string, tier int, score double")
    m = evaluate.metrics(df, "k", "score").first()
    assert m["map"] == 0 and m["ndcg10"] == pytest.approx(1 / math.log2(3))


def test_tree_columns_match_numpy(spark):
    names, model = trees.parse_model(MODEL)
    rng = np.random.default_rng(0)
    x = rng.normal(0, 2000, (50, 2)).astype(np.float32).astype(float)
    x[:, 1] = rng.integers(0, 25, 50)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i int, c_acctbal double, c_nationkey double")
    got = [r["p"] for r in df.select("i", trees.predict_column(names, model).alias("p")).orderBy("i").collect()]
    assert got == pytest.approx(sum(plain_trees.predict(t, x) for t in model))


def test_attributions_add_up():
    _, model = trees.parse_model(MODEL)
    rng = np.random.default_rng(1)
    for x in rng.normal(0, 1500, (20, 2)):
        phi = sum(plain_trees.attributions(t, x) for t in model)
        assert phi.sum() == pytest.approx(sum(plain_trees.predict(t, x[None])[0] for t in model))


def test_models_are_kept(spark, tmp_path):
    names, model = trees.parse_model(MODEL)
    path = str(tmp_path / "model")
    assert trees.load_model(spark, path) == (None, None)
    trees.save_model(spark, path, names, model)
    assert trees.load_model(spark, path) == (names, model)


def test_exact_split_and_quotas(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 7 else "z") for i in range(103)], "id int, s string")
    assert evaluate.split(df, "id").where("validation").count() == 20 and evaluate.split(df, "id").count() == 103
    strata = [(F.col("s") == "a", 0.3), (F.col("id") % 2 == 0, 0.1)]
    got = evaluate.sample_with_quotas(df, F.col("s") == "z", strata, 60, "id").collect()
    assert len(got) == len({r["id"] for r in got}) == 60 and sum(r["s"] == "z" for r in got) == 15
    assert sum(r["s"] == "a" for r in got) >= 18 and sum(r["id"] % 2 == 0 for r in got) >= 6
    few = evaluate.sample_with_quotas(df, F.col("s") == "z", strata, 10, "id").collect()
    assert len(few) == 10 and sum(r["s"] == "z" for r in few) >= 5
    assert evaluate.sample_with_quotas(df, F.lit(None).cast("boolean"), [], 500, "id").count() == 103


def test_judgments(spark):
    replies = ['{"tier": 3.7, "reasoning": "x", "key_factors": ["a"]}', '```json\n{"tier": "9"}\n```', 'so {"tier": -1} ok', "nothing", None, '{"tier": null}', "[1]"]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, r string")
    got = [r["t"] for r in df.select("i", labeling.parse_judgment(F.col("r"))["tier"].alias("t")).orderBy("i").collect()]
    assert got == [3, 4, 0, None, None, None, None]


def test_judge_resume_and_bucket(spark):
    messages = spark.createDataFrame([(i, f"m{i}") for i in range(6)], "id int, message string")
    done = spark.createDataFrame([(1,), (4,)], "id int")
    left = labeling.open_messages(messages, done, "id")
    replies = labeling.judge(left, "id", lambda text: text.upper(), 6000, 2).collect()
    assert sorted((r["id"], r["reply"]) for r in replies) == [(0, "M0"), (2, "M2"), (3, "M3"), (5, "M5")]
    now = [0.0]
    bucket = labeling.Bucket(60, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(90):
        bucket.take()
    assert now[0] == pytest.approx(30, abs=0.1)


def test_pauses_that_errors_ask_for():
    limited = ValueError("rate limit: please try again in 1m2.5s")
    assert labeling.pause_of(limited) == 62.5 and labeling.pause_of(ValueError("Try again in 7s.")) == 7 and labeling.pause_of(ValueError("no")) is None
    limited.retry_after = 3
    assert labeling.pause_of(limited) == 3


def test_open_messages_go_round_the_clients(spark, tmp_path):
    messages = spark.createDataFrame([(i, f"m{i}") for i in range(8)], "id int, message string")

    def spent(text):
        raise labeling.QuotaExhausted

    def shy(text):
        if text in ("m0", "m5"):
            raise labeling.QuotaExhausted
        return "b" + text

    path = str(tmp_path / "replies")
    first = labeling.judge_all(messages.where("id < 4"), "id", [spent, shy], path, 60_000, 1, tries=1)
    assert sorted((r["id"], r["reply"]) for r in first.collect()) == []
    got = labeling.judge_all(messages, "id", [spent, shy, lambda t: "c" + t], path, 60_000, 1).collect()
    assert sorted((r["id"], r["reply"]) for r in got) == [(i, f"cm{i}") for i in range(8)]
    assert labeling.judge_all(messages, "id", [spent], path, 60_000, 1).count() == 8


def test_retry_gives_up_and_quota_passes():
    def fail():
        raise ValueError

    def quota():
        raise labeling.QuotaExhausted

    pauses = []
    assert labeling.with_retry(fail, 3, pauses.append) is None and pauses == [3.0, 5.0, 9.0]
    with pytest.raises(labeling.QuotaExhausted):
        labeling.with_retry(quota)


def test_ranking_file_and_checkpoint(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 0.5, "y, z"), ("a", 1, 0.75, "x")], "candidate_id string, rank int, final double, reasoning string")
    store.write_ranking(df, str(tmp_path / "csv"))
    got = store.read_ranking(spark, str(tmp_path / "csv")).orderBy("rank").collect()
    assert [(r["candidate_id"], r["score"], r["reasoning"]) for r in got] == [("a", 0.75, "x"), ("b", 0.5, "y, z")]
    records = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "id int, at int, tier string")
    store.append_checkpoint(records, str(tmp_path / "json"))
    got = store.read_checkpoint(spark, str(tmp_path / "json"), "id int, at int, tier string", "id", "at").collect()
    assert sorted((r["id"], r["tier"]) for r in got) == [(1, "new"), (2, "only")]


def test_config_interpolation():
    assert store.filled({"root": "/d", "a": "${root}/x", "b": "${a}/y", "c": "${nobody}", "d": "${d}"}) == {"root": "/d", "a": "/d/x", "b": "/d/x/y", "c": "${nobody}", "d": "${d}"}


def test_config_file(spark, tmp_path):
    text = """# a comment
paths:
  root: data   # where all lies
  store: ${root}/store
  far: s3://bucket/x
  fixed: /abs/y
model: {name}
weights:
  - 0.5
  - 2
seed: 42
deep: true
empty:
names: [a, "b c"]
""".replace("{name}", "'first # one'")
    (tmp_path / "config.yaml").write_text(text)
    got = store.read_config(spark, f"file://{tmp_path}/config.yaml")
    assert got["paths"] == {"root": f"file://{tmp_path}/data", "store": f"file://{tmp_path}/data/store", "far": "s3://bucket/x", "fixed": "/abs/y"}
    assert (got["weights"], got["seed"], got["deep"], got["empty"], got["names"]) == ([0.5, 2], 42, True, None, ["a", "b c"])
    assert store.anchored("../z", "/a/b") == "/a/z" and store.parse_yaml("") == {}


def test_stores_are_read_as_written(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0], 3), ("b", [0.0, 1.0], 4)], "candidate_id string, embedding array<float>, tier int")
    store.save(df, f"{tmp_path}/s")
    store.save(df, f"{tmp_path}/s")
    got = store.load(spark, f"{tmp_path}/s")
    assert got.schema == df.schema and sorted(got.collect()) == sorted(df.collect())
    store.save(df, f"{tmp_path}/s", "append")
    assert store.load(spark, f"{tmp_path}/s").count() == 4


def test_workbook(tmp_path):
    pytest.importorskip("openpyxl")
    assert store.write_workbook([{"candidate_id": "a", "rank": 1, "score": 0.5, "reasoning": "x"}], str(tmp_path / "r.xlsx"))


def test_messages_are_capped(spark):
    df = spark.createDataFrame([("k" * 400, [1] * 9)], "name string, list array<int>")
    sent = json.loads(df.select(labeling.message(df, "judge", lists=5, chars=280).alias("m")).first()[0])
    user = json.loads(sent["user"])
    assert sent["system"] == "judge" and len(user["name"]) == 280 and user["list"] == [1] * 5


def test_cache_of_vectors(spark):
    rows = [(i, i, [float(i)]) for i in range(6)]
    cache = spark.createDataFrame(rows, "id long, place long, embedding array<float>")
    wanted = spark.createDataFrame([(i, p, f"t{i}") for p, i in enumerate((5, 4, 3, 2, 1, 0))], "id long, place long, text string")
    how, got = vectors.filled(cache, wanted, lambda missing: pytest.fail("nothing is missing"))
    assert how == "reordered" and {r["id"]: r["place"] for r in got.collect()} == {i: 5 - i for i in range(6)}
    how, got = vectors.filled(cache.where("id > 1"), wanted, lambda missing: missing.select("id", F.array(F.length("text").cast("float")).alias("embedding")))
    assert how == "refilled" and sorted((r["id"], r["embedding"][0], r["new"]) for r in got.collect()) == [(0, 2, True), (1, 2, True), *((i, i, False) for i in range(2, 6))]
    same = vectors.fingerprint(cache, "id", "place").first()
    assert same == vectors.fingerprint(cache.repartition(5), "id", "place").first() != vectors.fingerprint(cache.withColumn("place", 5 - F.col("place")), "id", "place").first()


def test_attributions_in_columns(spark):
    """Random trees with features that repeat on a path, against the plain form."""
    rng = np.random.default_rng(6)
    tree = {"split_feature": [0, 1, 0, 2], "threshold": [0.0, -0.5, 1.0, 0.25], "left_child": [1, -1, -3, -4], "right_child": [2, -2, 3, -5], "leaf_value": [0.3, -0.2, 0.1, 0.7, -0.4], "leaf_count": [5.0, 7, 11, 13, 4], "internal_count": [40.0, 12, 28, 17]}
    names, model = ["a", "b", "c", "unused"], [tree, {"leaf_value": [0.5]}]
    x = rng.normal(size=(40, 4)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id int, a double, b double, c double, unused double")
    got = {}
    for r in trees.top_attributions(df, "id", names, model, k=4, labels={"a": "first"}).collect():
        got.setdefault(r["id"], {})[r["factor"]] = r["shap_value"]
        assert r["label"] == ("first" if r["factor"] == "a" else r["factor"])
    for i, row in enumerate(x):
        want = sum(plain_trees.attributions(t, row) for t in model)
        assert [got[i][n] for n in names] == pytest.approx(want[:-1])
    one = trees.top_attributions(df.where("id = 3"), "id", names, model, k=1).collect()
    assert len(one) == 1 and abs(one[0]["shap_value"]) == pytest.approx(max(abs(v) for v in got[3].values()))


@pytest.mark.parametrize("text", ['{"b":1,"a":{"d":-2.5e3,"c":[1,{"z":"x: {5, \\"q\\"}"}]},"e":{}}', "[]", '{"k":"{\\"a\\":1}"}'])
def test_rewriting_keeps_the_meaning(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    ways = df.select(rewrite.sorted_keys(F.col("t")), rewrite.with_unknown_fields(F.col("t")), rewrite.with_quoted_numbers(F.col("t"))).first()
    value = json.loads(text)
    assert json.loads(ways[0]) == value

    def without(v):
        if isinstance(v, dict):
            assert "_unknown" in v
            return {k: without(x) for k, x in v.items() if k != "_unknown"}
        return [without(x) for x in v] if isinstance(v, list) else v

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else float(v) if not isinstance(v, str) or v.lstrip("-")[:1].isdigit() else v

    def numbers(v):
        inner = v.values() if isinstance(v, dict) else v if isinstance(v, list) else []
        return isinstance(v, int | float) or any(map(numbers, inner))

    seen = json.loads(ways[1].replace("[{},null]", "[]"))
    assert without(seen) == value
    assert plain(json.loads(ways[2])) == plain(value) and not numbers(json.loads(ways[2]))


def test_results_do_not_hang_on_partitions(spark):
    from quillrank.queries import QUERIES

    d = "/root/testdata/sf0.001"
    a = QUERIES["rank_top100"](spark, d).collect()
    b = QUERIES["rank_top100"](spark, d).repartition(7).collect()
    assert sorted(a) == sorted(b)
