"""Prefix trie of conversations: owned chains found by binary search over prefix digests.

A node is a distinct sequence of first turns; its owner is the smallest conversation that
starts with it. Deeper prefixes have fewer members, so once a conversation owns a prefix it
owns all its longer ones: what it owns is one chain, from its first owned depth to its
end. That depth is found by binary search, all conversations at once: each round joins the
digests at the middle depths with the minima (digest -> smallest member) of prefixes that
several conversations share.

Chains are the tree: each hangs on the chain that owns the prefix above it. Chains are
summed bottom-up (a node's value and those below it in its chain), then each chain's total
goes to all prefixes above it in one aggregate, which works for any nesting.

Turns are numbered and digests run on within ranges (ranges.running), so neither a long
conversation nor a prefix that all conversations share is gathered in a task. A prefix is
known by two 64-bit hashes, each the exclusive or of its turns' hashes with their depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.arrays import frugal
from quillrank.llm.shared import discard, stored, table
from quillrank.operators.ranges import running

#: What names a prefix.
PREFIX = ("depth", "a", "b")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), x and y (two hashes of role and text), octets: turns in order.

    Null roles and texts are empty. Turns of one number come in order of role and hashes.
    Rows without conv_id belong to no conversation.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", text("role").alias("role"), text("text").alias("t"))
    rows = rows.select("conv_id", "turn", "role", F.xxhash64(F.lit(1), "role", "t").alias("x"), F.xxhash64(F.lit(2), "role", "t").alias("y"), F.octet_length("t").cast("long").alias("octets"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("x"), F.col("y")]
    return running(rows, ["conv_id"], order, "depth").select("conv_id", "depth", "x", "y", "octets")


def rebuilt(own: DataFrame, base: Column, head: Column, most_head: int) -> DataFrame:
    """Turns (as of turns()) of rebuilt conversations: `head` turns of `base`, then the own ones after those.

    `base` and `head` are columns over conv_id, `head` at most `most_head`. Conversations
    that end up without turns have no rows.
    """
    lengths = own.groupBy("conv_id").agg(F.max("depth").alias("length"))
    asked = lengths.select("conv_id", base.alias("base"), head.cast("long").alias("head"))
    found = asked.join(lengths.select(F.col("conv_id").alias("base"), F.col("length").alias("there")), "base", "left")
    found = found.select("conv_id", "base", "head", F.least("head", F.coalesce("there", F.lit(0))).alias("taken"))
    heads = own.where(F.col("depth") <= most_head).withColumnRenamed("conv_id", "base").join(found, "base").where("depth <= head")
    rest = own.join(found.select("conv_id", "head", "taken"), "conv_id").where("depth > head")
    columns = ["conv_id", "depth", "x", "y", "octets"]
    return heads.select(*columns).unionByName(rest.withColumn("depth", F.col("depth") - F.col("head") + F.col("taken")).select(*columns))


def prefixes(turned: DataFrame) -> DataFrame:
    """conv_id, depth, a, b, octets (of the last text) of every prefix with a turn."""
    salted = turned.select("conv_id", "depth", "octets", F.xxhash64("depth", "x").alias("x"), F.xxhash64("depth", "y").alias("y"))
    return running(salted, ["conv_id"], [F.col("depth")], None, {"a": ("bit_xor", "x"), "b": ("bit_xor", "y")}).select("conv_id", *PREFIX, "octets")


def first_owned(paths: DataFrame, lengths: DataFrame, shared: DataFrame) -> DataFrame:
    """conv_id, length, first: the first depth that a conversation owns; length + 1 if it owns none.

    `shared` (depth, a, b, owner) has the prefixes of several conversations; all others
    are owned by the one that has them. Only unfinished searches go through the joins.
    """
    now = stored(lengths.select("conv_id", "length", F.lit(1).cast("long").alias("low"), (F.col("length") + 1).alias("high")), "trie-search", small=True)
    done = [now.where("low >= high")]
    tables = [now]
    while True:
        open_ = now.where("low < high")
        if not open_.take(1):
            break
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        asked = open_.withColumn("depth", middle).join(paths.select("conv_id", *PREFIX), ["conv_id", "depth"])
        told = asked.join(shared.select(*PREFIX, "owner"), list(PREFIX), "left")
        mine = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True))
        low, high = F.when(mine, F.col("low")).otherwise(F.col("depth") + 1), F.when(mine, F.col("depth")).otherwise(F.col("high"))
        now = stored(told.select("conv_id", "length", low.alias("low"), high.alias("high")), "trie-search", small=True)
        done.append(now.where("low >= high"))
        tables.append(now)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    found = stored(out.select("conv_id", "length", F.col("low").alias("first")), "trie-first", small=True)
    discard(*tables)
    return found


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 of the prefixes where conversations end (conv_id, depth, a, b).

    Ids are joined in ranges of conv_id first, before they are shuffled by prefix; the
    digest of a prefix then streams through one task, a piece per range.
    """
    parts = ends.repartitionByRange("conv_id").withColumn("part", F.spark_partition_id())
    joined = parts.groupBy(*PREFIX, "part").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    texts = joined.select(*PREFIX, F.col("ids")[0].alias("least"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def report() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({c: pa.array([v], pa.int64()) for c, v in zip(PREFIX, key, strict=True)} | {"ends_sha256": [digest.hexdigest()]})

        for batch in batches:
            done = []
            for *found, text in zip(*(batch.column(c).to_pylist() for c in (*PREFIX, "text")), strict=True):
                if digest is not None and found == key:
                    digest.update(b"," + text.encode())
                    continue
                if digest is not None:
                    done.append(report())
                key, digest = found, hashlib.sha256(text.encode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if digest is not None:
            yield report()

    by = texts.repartition(*PREFIX).sortWithinPartitions(*PREFIX, "least").select(*PREFIX, "text")
    return by.mapInArrow(frugal(run), "depth long, a long, b long, ends_sha256 string")


def trie(turned: DataFrame, every: DataFrame) -> DataFrame:
    """A row per node of the trie over conversations `every` (conv_id) with their turns (of turns() or rebuilt()).

    conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. The root is at depth 0, also for conversations without turns; without
    conversations there is no node.
    """
    paths = stored(prefixes(turned), "trie-paths")
    every = stored(every.distinct(), "trie-every", small=True)
    least, total = every.agg(F.min("conv_id"), F.count("*")).first()
    lengths = stored(every.join(paths.groupBy("conv_id").agg(F.max("depth").alias("length")), "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0).cast("long")).alias("length")), "trie-lengths", small=True)
    nodes = paths.groupBy(*PREFIX).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("octets").alias("octets"))
    shared = stored(nodes.where("n_convs > 1"), "trie-shared", small=True)
    chains = first_owned(paths, lengths, shared)
    # the values of a chain's shared nodes, summed from its end up; nodes of one conversation save nothing
    worth = shared.select(F.col("owner").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("octets")).alias("worth"))
    sums = stored(running(worth, ["conv_id"], [F.col("depth").desc()], None, {"below": ("sum", "worth")}).select("conv_id", "depth", "below"), "trie-sums", small=True)
    owned = chains.where("first <= length")
    totals = owned.join(sums.select("conv_id", F.col("depth").alias("first"), F.col("below").alias("total")), ["conv_id", "first"], "left").select("conv_id", "length", "first", F.coalesce("total", F.lit(0)).alias("total"))
    # chains that hang on a prefix, counted where they do
    tops = totals.where("first > 1").select("conv_id", (F.col("first") - 1).alias("depth")).join(paths.select("conv_id", *PREFIX), ["conv_id", "depth"])
    hanging = stored(tops.groupBy(*PREFIX).agg(F.count("*").alias("hanging")), "trie-hanging", small=True)
    ends = stored(lengths.where("length > 0").withColumnRenamed("length", "depth").join(paths.select("conv_id", *PREFIX), ["conv_id", "depth"]), "trie-ends")
    closed = ends.join(hanging, list(PREFIX), "left_semi").select("conv_id").withColumn("inner", F.lit(True))
    leaves = stored(totals.join(closed, "conv_id", "left").select("conv_id", "length", "first", "total", F.coalesce(~F.col("inner"), F.lit(True)).cast("long").alias("leaf")), "trie-chains", small=True)
    above = paths.join(leaves.where("first > 1"), "conv_id").where("depth < first")
    passing = above.groupBy(*PREFIX).agg(F.sum("total").alias("saved"), F.sum("leaf").alias("leaves"))
    # the nodes: what each chain owns
    chain_rows = paths.join(leaves, "conv_id").where("depth >= first").select("conv_id", *PREFIX, "length", "first", "leaf")
    parents = leaves.where("first > 1").select("conv_id", (F.col("first") - 1).alias("depth")).join(paths.select("conv_id", *PREFIX), ["conv_id", "depth"]).join(shared.select(*PREFIX, "owner"), list(PREFIX)).select(F.col("conv_id"), F.col("owner").alias("parent"))
    facts = shared.select(*PREFIX, "n_convs").join(passing, list(PREFIX), "left").join(hanging, list(PREFIX), "left")
    out = chain_rows.join(parents, "conv_id", "left").join(facts, list(PREFIX), "left").join(digests_of_ends(ends), list(PREFIX), "left").join(sums, ["conv_id", "depth"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = out.select(
        "conv_id", "depth",
        F.when(F.col("depth") > F.col("first"), F.col("conv_id")).when(F.col("first") == 1, F.lit(least)).otherwise(F.col("parent")).cast("long").alias("parent_conv_id"),
        F.coalesce("n_convs", F.lit(1)).cast("long").alias("n_convs"),
        (zero("hanging") + (F.col("depth") < F.col("length")).cast("long")).alias("n_children"),
        (zero("leaves") + F.col("leaf")).alias("n_leaves"),
        (zero("saved") + zero("below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
    if not total:
        return rows
    return rows.unionByName(root(every, lengths, leaves, least, total))


def root(every: DataFrame, lengths: DataFrame, leaves: DataFrame, least: int, total: int) -> DataFrame:
    """The row of the textless root: all conversations are its members."""
    tops = leaves.agg(F.count_if(F.col("first") == 1).alias("n_children"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("total"), F.lit(0)).alias("saved_tokens"))
    bare = lengths.where("length = 0").select("conv_id", *(F.lit(0).cast("long").alias(c) for c in PREFIX))
    digest = digests_of_ends(bare).select("ends_sha256")
    # one row on either side
    return tops.join(F.broadcast(digest), F.lit(True), "left").select(
        F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total).cast("long").alias("n_convs"), "n_children",
        F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """trie() of a table (conv_id, turn, role, text) as it is.

    Rows without conv_id are in no conversation, null roles and texts are empty, turns of
    one number come in order of role and hashes, repeated rows are turns of their own, other
    columns are left alone, texts of any length count whole; an empty table has no node.
    """
    own = stored(turns(conversations), "trie-turns")
    return trie(own, own.select("conv_id"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(turns(table(spark, sf_dir, "conversations")), "trie-turns")
    conv = F.col("conv_id")
    return trie(rebuilt(own, conv - conv % 5, F.crc32(conv.cast("string")) % 9, 8), own.select("conv_id"))


SQL = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
    lambda h, x: list_reduce(list_prepend(xor(h, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END)), 4294967295::BIGINT) % 9 AS h
  FROM ids),
own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
sized AS (SELECT crc.c, h, least(h, (SELECT count(*) FROM own WHERE own.c = crc.c - crc.c % 5)) AS m FROM crc),
built AS (
  SELECT s.c, o.i AS d, role, text FROM sized s JOIN own o ON o.c = s.c - s.c % 5 AND o.i <= s.h
  UNION ALL SELECT s.c, o.i - s.h + s.m, role, text FROM sized s JOIN own o ON o.c = s.c AND o.i > s.h),
keyed AS (
  SELECT c, d, strlen(text) AS octets, sha256(string_agg(sha256(length(role) || ':' || role || text), '' ) OVER (PARTITION BY c ORDER BY d)) AS p FROM built
  UNION ALL SELECT c, 0, 0, '' FROM ids),
node AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, max(octets) AS octets FROM keyed GROUP BY d, p),
up AS (SELECT DISTINCT k.d, k.p, q.p AS parent FROM keyed k JOIN keyed q ON q.c = k.c AND q.d = k.d - 1),
below AS (SELECT DISTINCT q.d AS d, q.p AS p, k.d AS e, k.p AS r FROM keyed k JOIN keyed q ON q.c = k.c AND q.d <= k.d),
kids AS (SELECT d - 1 AS d, parent AS p, count(*) AS n FROM up GROUP BY ALL),
subtree AS (
  SELECT b.d, b.p, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.octets) AS saved
  FROM below b JOIN node n ON n.d = b.e AND n.p = b.r LEFT JOIN kids ON kids.d = b.e AND kids.p = b.r GROUP BY ALL),
ends AS (
  SELECT d, p, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM (SELECT c, d, p FROM keyed QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC) = 1) GROUP BY ALL)
SELECT node.conv_id, node.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, node.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM node JOIN subtree USING (d, p) LEFT JOIN kids USING (d, p) LEFT JOIN ends USING (d, p) LEFT JOIN up USING (d, p) LEFT JOIN node parent ON parent.d = node.d - 1 AND parent.p = up.parent
"""
