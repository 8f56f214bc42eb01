"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node with a weight. Nodes are dealt to shards by a hash, so no shard
is larger than SHARD_ROWS by more than chance; each shard's graph is built in one task.
Every pair of shards meets in one tile: the vectors of the one search the graph of the
other. A search whose beam ends while it still finds links goes on with a wider one. In
each tile a fixed share of the searches is audited against a direct comparison; while the
audit finds less than AUDIT_RECALL, the tile is searched again with beams twice as wide,
at last as wide as the shard. Found pairs are verified by their cosine in double precision.

Pairs never leave a tile: it sends numbers of links per node and the edges of a spanning
forest of what it has found, which joins the same nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import hnsw
from quillrank.llm.arrays import frugal
from quillrank.llm.components import components
from quillrank.llm.shared import discard, small_batches, stored, table, unused

THRESHOLD = 0.95
SHARD_ROWS = 1 << 16  # nodes of a shard, about: some 100 MB with its graph
LEAST_SHARDS = 8
BEAM = 24
AUDIT_EVERY = 16  # one of so many searches is audited, 64 of a tile at least
AUDIT_RECALL = 0.99
SLACK = 1e-5  # of similarities in single precision

INDEX = "dim int, shard int, nodes binary, weights binary, vectors binary, graph array<binary>"


def linkable(vector: Column) -> Column:
    """Whether a vector can link: not null, all components finite, not zero."""
    wrong = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(~F.exists(vector, wrong) & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in single precision."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision; rows are scaled first, so nothing overflows."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


class Shard:
    """A shard's nodes, weights and vectors, and its graph if given."""

    def __init__(self, dim: int, nodes: bytes, weights: bytes, vectors: bytes, graph: list[bytes] | None = None):
        self.nodes, self.weights = np.frombuffer(nodes, np.int64), np.frombuffer(weights, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(len(self.nodes), dim)
        self.graph = None
        if graph is None:
            self.units = units(self.vectors)
            return
        self.units = np.frombuffer(graph[0], np.float32).reshape(len(self.nodes), dim)
        members = [np.frombuffer(x, np.int64) for x in graph[1::2]]
        links = [np.frombuffer(x, np.int32).reshape(len(m), -1) for x, m in zip(graph[2::2], members, strict=True)]
        self.graph = hnsw.Graph(self.units, members, links)


def built(group: pa.Table) -> pa.Table:
    """A shard's row of INDEX; `group` has dim, shard, node, weight and vector."""
    group = group.sort_by("node")
    dim = group.column("dim")[0].as_py()
    vectors = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    parts = [np.ascontiguousarray(x).tobytes() for x in hnsw.build(units(vectors)).parts()]
    nodes, weights = (group.column(c).to_numpy().astype(np.int64).tobytes() for c in ("node", "weight"))
    return pa.Table.from_pydict({"dim": pa.array([dim], pa.int32()), "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "nodes": [nodes], "weights": [weights], "vectors": [vectors.tobytes()], "graph": [parts]})


def direct(queries: np.ndarray, shard: Shard, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) of pairs that may link, by comparing all: a beam as wide as the shard."""
    return np.nonzero(queries @ shard.units.T >= threshold - SLACK)


def searched(queries: np.ndarray, shard: Shard, beam: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) of pairs that may link; beams that end with a link are widened."""
    found_q, found_v = [], []
    left = np.arange(len(queries))
    while len(left):
        if 2 * beam >= len(shard.nodes):
            q, v = direct(queries[left], shard, threshold)
            found_q.append(left[q])
            found_v.append(v)
            break
        ids, sims = hnsw.search(shard.graph, queries[left], beam)
        hit = (sims >= threshold - SLACK) & (ids >= 0)
        more = hit[:, -1]
        q, at = np.nonzero(hit & ~more[:, None])
        found_q.append(left[q])
        found_v.append(ids[q, at])
        left, beam = left[more], 4 * beam
    return np.concatenate(found_q), np.concatenate(found_v)


class Forest:
    """Components of the nodes of a tile, as labels: the least number each is joined with."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def tile(left: Shard, right: Shard, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """(links of left nodes, of right nodes, forest's ends u and v, recall of the last audit)."""
    n = len(left.nodes)
    audited = np.unique(np.concatenate((np.arange(0, n, AUDIT_EVERY), np.linspace(0, n - 1, 64).astype(np.int64))))
    true_q, true_v = direct(left.units[audited], right, threshold)
    want = np.unique(audited[true_q] * len(right.nodes) + true_v)
    beam = BEAM
    while True:
        counts = np.zeros(n, np.int64), np.zeros(len(right.nodes), np.int64)
        forest, met = Forest(n + len(right.nodes) * (not same)), 0
        for a in range(0, n, hnsw.BLOCK):
            q, v = searched(left.units[a : a + hnsw.BLOCK], right, beam, threshold)
            q = q + a
            met += np.isin(q * len(right.nodes) + v, want).sum()
            if same:  # each pair once, from its smaller side
                q, v = q[v > q], v[v > q]
            for b in range(0, len(q), 1 << 16):
                x, y = q[b : b + (1 << 16)], v[b : b + (1 << 16)]
                real = cosines(left.vectors[x], right.vectors[y]) >= threshold
                x, y = x[real], y[real]
                np.add.at(counts[0], x, right.weights[y])
                np.add.at(counts[0] if same else counts[1], y, left.weights[x])
                forest.join(x, y if same else y + n)
        recall = met / len(want) if len(want) else 1.0
        if recall >= AUDIT_RECALL or 2 * beam >= len(right.nodes):
            break
        beam *= 2
    nodes = left.nodes if same else np.concatenate((left.nodes, right.nodes))
    joined = np.flatnonzero(forest.label != np.arange(len(nodes)))
    return *counts, nodes[joined], nodes[forest.label[joined]], recall


def shards_of(nodes: DataFrame, shard_rows: int) -> DataFrame:
    """INDEX of the shards of `nodes` (node, weight, vector, dim); vectors of one length meet only each other."""
    number = max(LEAST_SHARDS, -(-nodes.count() // shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(number)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInArrow(built, INDEX)


def links(index: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of each tile: u, null, n (n more links of node u) and u, v, null (edges of its forest)."""
    shards = index.select("dim", "shard").distinct()
    most = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    # each shard meets itself and the half of the others that follow it in a circle
    half = F.sequence(F.lit(0), F.when((F.col("i") < most // 2) | F.lit(most % 2 == 1), most // 2).otherwise(max(0, (most - 1) // 2)).cast("int"))
    left = index.select("dim", F.col("shard").alias("i"), *(F.col(c).alias(f"own_{c}") for c in ("nodes", "weights", "vectors")))
    left = left.withColumn("step", F.explode(half)).withColumn("shard", F.pmod(F.col("i") + F.col("step"), F.lit(most)))
    copies = max(1, 32 // most)  # so that a few shards keep many tasks busy
    left = left.withColumn("copy", F.pmod("i", F.lit(copies)))
    right = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    tiles = left.join(right.hint("shuffle_hash"), ["dim", "shard", "copy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                left = Shard(row["dim"], row["own_nodes"], row["own_weights"], row["own_vectors"])
                right = Shard(row["dim"], row["nodes"], row["weights"], row["vectors"], row["graph"])
                a, b, u, v, _ = tile(left, right, row["step"] == 0, threshold)
                for nodes, n in ((left.nodes, a), (right.nodes, b)):
                    some = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(n[some])], names=["u", "v", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], names=["u", "v", "n"])

    columns = ["dim", "step", "own_nodes", "own_weights", "own_vectors", "nodes", "weights", "vectors", "graph"]
    return tiles.select(*columns).mapInArrow(frugal(run), "u long, v long, n long")


def near_vectors(rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """`rows` without the vector, with n_links, component_id (least id reachable) and kept (id = component_id).

    Links are pairs of rows with cosine >= threshold. Each row is a vector of its own, also
    where ids or whole rows repeat; a null id is never the least one unless all are null
    (then component_id is null and the rows are kept). Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do vectors of different
    length. Columns of the new names are replaced; an empty table gives an empty result.
    """
    small_batches(rows.sparkSession)
    new = ("n_links", "component_id", "kept")
    base = rows.drop(*(c for c in rows.columns if c in new and c not in (id_, vector)))
    taken = set(base.columns)
    p, q = unused("p", taken), unused("q", taken)
    usable = linkable(F.col(vector))
    base = base.withColumn(p, F.when(usable, F.xxhash64(F.lit(1), vector))).withColumn(q, F.when(usable, F.xxhash64(F.lit(2), vector)))
    same = base.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p"), F.col(q).alias("q")).agg(F.count("*").alias("weight"), F.min(id_).alias("least"), F.first(vector).alias("vector"))
    nodes = stored(same.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "vectors-nodes")
    index = stored(shards_of(nodes.select("node", "weight", "vector", "dim"), shard_rows), "vectors-index")
    found = stored(links(index, threshold), "vectors-links")
    numbers = found.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    roots = stored(components(found.where("v IS NOT NULL").select("u", "v"), "vectors-edges"), "vectors-roots", small=True)
    named = nodes.select("node", "least", "weight", "p", "q")
    least = roots.join(named.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    of_node = roots.join(least, "root").select("node", "component")
    judged = named.join(numbers, "node", "left").join(of_node, "node", "left")
    judged = stored(judged.select(F.col("p").alias("_p"), F.col("q").alias("_q"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("_n"), F.coalesce("component", "least").alias("_c")), "vectors-judged", small=True)
    discard(index, found, nodes, roots)
    kept = [c for c in base.columns if c not in (vector, p, q)]
    linked = base.where(F.col(p).isNotNull()).join(judged, (F.col(p) == F.col("_p")) & (F.col(q) == F.col("_q"))).select(*kept, F.col("_n").alias("n_links"), F.col("_c").alias("component_id"))
    alone = base.where(F.col(p).isNull()).select(*kept, F.lit(0).cast("long").alias("n_links"), F.col(id_).alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col(id_).eqNullSafe(F.col("component_id")))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.n AS a, b.n AS b, b.vec_id AS least FROM ok a JOIN ok b ON a.n <> b.n AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS n, min(vec_id) AS c FROM reach JOIN v ON v.n = b GROUP BY a),
number AS (SELECT a AS n, count(*) AS k FROM links GROUP BY a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, least(vec_id, c)::BIGINT AS component_id, vec_id = least(vec_id, c) AS kept FROM v LEFT JOIN least USING (n) LEFT JOIN number USING (n)
"""
