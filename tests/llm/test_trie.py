"""The prefix trie against a plain tree, with rebuilt and plain conversations and odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillrank.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def plain(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, held in convs.items():
        for d in range(len(held) + 1):
            members[tuple(held[:d])].append(c)
        ends[tuple(held)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        leaves = saved = 0
        stack = [p]
        while stack:
            q = stack.pop()
            saved += (len(members[q]) - 1) * len(q[-1][1].encode()) if q else 0
            leaves += not children[q]
            stack += children[q]
        return leaves, saved

    for p, of in list(members.items()):
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        yield (min(of), len(p), min(members[p[:-1]]) if p else None, len(of), len(children[p]), *below(p), sha)


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        convs[c].append((role or "", text or ""))
    return convs


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for c in range(80):
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            out.append((c, None if t == 0 and c % 3 else t, rng.choice(["user", "assistant", None]) if c % 7 else "user", rng.choice(["a", "b", None, "é" * 3]), 5))
    out += [(c, t, "user", "same", 1) for c in range(100, 140) for t in range(3)]  # a third of all
    out += [(200, t, "user", f"t{t % 4}", 1) for t in range(300)]
    out += [(205, t, "user", f"t{t % 4}" if t < 250 else "else", 1) for t in range(300)]
    out += [(None, 1, "user", "nobody's", 1)]
    return [r for r in out if r[0] != 55]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_trie(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(trie.conversation_trie(df)) == sorted(plain(ordered(rows)), key=str)


def test_query_on_odd_rows(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    want = rebuilt(ordered(rows))
    assert any(not held for held in want.values())
    assert found(trie.op11_trie(spark, str(tmp_path))) == sorted(plain(want), key=str)


def test_ties_and_repeated_rows(spark):
    rows = [(1, 1, "user", "x", 0), (1, 1, "user", "x", 0), (2, 1, "user", "x", 0), (2, None, "user", "x", 0), (3, 1, "b", "y", 0), (3, 1, "a", "y", 0), (4, 1, "a", "y", 0), (4, 1, "b", "y", 0)]
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).where("depth = 2").select("conv_id", "n_convs").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (3, 2)]


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.conversation_trie(empty).count() == 0
    only = spark.createDataFrame([(7, 0, "user", "hi", 0)], SCHEMA).withColumn("conv_id", F.col("conv_id"))
    assert found(trie.conversation_trie(only)) == sorted(plain({7: [("user", "hi")]}), key=str)
