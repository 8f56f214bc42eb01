"""Near vectors against all pairs, with odd vectors, a large group of near copies and repeated rows."""

from __future__ import annotations

import numpy as np
import pytest

from quillrank.llm import hnsw, neighbours

SCHEMA = "vec_id long, embedding array<double>, n_links int, extra string"


def plain(rows, threshold=0.95):
    """(id, links, component, kept) per row by comparing all pairs."""
    ok = [i for i, (_, v, *_) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    by_size = {}
    for i in ok:
        by_size.setdefault(len(rows[i][1]), []).append(i)
    for group in by_size.values():
        e = np.array([rows[i][1] for i in group])
        e = e / np.abs(e).max(1, keepdims=True)
        near = (e @ e.T) / np.outer(*[np.sqrt((e * e).sum(1))] * 2) >= threshold
        for a, b in zip(*np.nonzero(near), strict=True):
            if a != b:
                links[group[a]] += 1
                parent[top(group[a])] = top(group[b])
    members = {}
    for i in range(len(rows)):
        members.setdefault(top(i), []).append(rows[i][0])
    out = []
    for i, (id_, *_) in enumerate(rows):
        known = [x for x in members[top(i)] if x is not None]
        least = min(known) if known else None
        out.append((id_, links[i], least, id_ == least))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(500, 24))
    out = [(int(i), v.tolist()) for i, v in enumerate(base)]
    near = lambda v, s: (v + rng.normal(size=24) * s * np.linalg.norm(v) / 5).tolist()
    out += [(1000 + i, near(base[3], 0.1)) for i in range(300)]  # a third of all
    out += [(2000 + i, near(base[i % 40], 0.15)) for i in range(120)]
    out += [(3000 + i, base[7].tolist()) for i in range(30)] + [(4000, (base[7] * 3).tolist()), (4001, (base[7] * 1e200).tolist()), (4002, (-base[7]).tolist())]
    out += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [None] * 24), (5004, [float("nan")] * 24), (5005, [float("inf")] + [1.0] * 23), (5006, [1.0, 2.0]), (5007, [2.0, 4.0])]
    out += [(None, base[9].tolist()), (None, [3.0, -1.0, 2.0]), (3001, base[7].tolist()), (12, base[13].tolist())]
    return [(i, v, 4, "x") for i, v in out]


@pytest.mark.parametrize("shard_rows", [1 << 16, 40])
def test_near_vectors(spark, rows, shard_rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = neighbours.near_vectors(df, shard_rows=shard_rows)
    assert got.columns == ["vec_id", "extra", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.drop("extra").collect()), key=str) == plain(rows)


def test_search_by_the_graph():
    """The graph itself, with beams far narrower than the shard, and links back from full lists."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3000, 32))
    base = np.concatenate((base, base[:400] + rng.normal(size=(400, 32)) * 0.1, base[5] + rng.normal(size=(300, 32)) * 0.15))
    unit = neighbours.units(base)
    graph = hnsw.build(unit)
    assert [len(m) for m in graph.members] == sorted((len(m) for m in graph.members), reverse=True) and len(graph.members) > 1
    for members, links in zip(graph.members, graph.links, strict=True):
        assert links.max() < len(members) and not (links == np.arange(len(members))[:, None]).any()
    shard = neighbours.Shard(32, np.arange(len(base)).tobytes(), np.ones(len(base), np.int64).tobytes(), base.tobytes(), [x.tobytes() for x in graph.parts()])
    queries = unit[::7]
    want = set(zip(*map(np.ndarray.tolist, neighbours.direct(queries, shard, 0.95)), strict=True))
    got = set(zip(*map(np.ndarray.tolist, neighbours.searched(queries, shard, 16, 0.95)), strict=True))
    assert got <= want and len(got) >= 0.99 * len(want)


def test_audit_widens_beams(monkeypatch):
    """Where narrow beams find too little, the tile is searched again until the audit passes."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(400, 16))
    data = np.concatenate((base, base + rng.normal(size=base.shape) * 0.05))
    unit = neighbours.units(data)
    graph = hnsw.build(unit)
    graph.links[0][:] = -1  # a graph without ways
    parts = [x.tobytes() for x in graph.parts()]
    shard = neighbours.Shard(16, np.arange(800).tobytes(), np.ones(800, np.int64).tobytes(), data.tobytes(), parts)
    a, _, u, v, recall = neighbours.tile(shard, shard, True, 0.95)
    assert recall == 1.0 and a.sum() >= 800 and len(u) == len(v) >= 400


def test_forest():
    forest = neighbours.Forest(9)
    forest.join(np.array([8, 6, 3]), np.array([7, 8, 4]))
    forest.join(np.array([7, 0]), np.array([3, 1]))
    assert forest.label.tolist() == [0, 0, 2, 3, 3, 5, 3, 3, 3]


def test_nothing(spark):
    assert neighbours.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    one = neighbours.near_vectors(spark.createDataFrame([(4, None, 1, "x")], SCHEMA)).collect()
    assert [tuple(r) for r in one] == [(4, "x", 0, 4, True)]
