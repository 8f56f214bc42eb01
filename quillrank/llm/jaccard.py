"""N-gram Jaccard join as a blocked sparse product of documents by shingles.

The incidence matrix has a row per different set and a column per shingle. Two sets x, y
are linked when den * |x & y| >= num * |x | y|, so a linked set can lack or add only a
few columns, a number that follows from the sizes (Likeness.misses).

1. A Spark job counts in how many documents each shingle occurs (frequency.py). Columns are
   ordered rarest first; the order is the same everywhere, so two linked sets share a
   column among the first misses + 1 of each. Only these cells are kept, and of them only
   those whose column may occur twice: most documents keep none.
2. The product over these cells: sets that share a column meet, overlap counts accumulate
   per pair, and a pair is discarded as soon as the count and what can still follow (from
   the sizes and the last common column) stay below the bound. The overlap of the pairs
   that are left is counted on the whole sets.
3. A column of more than SMALL sets is no place to pair everybody: near copies of one
   text. Such columns become groups (those with the same least member are one). A group
   of bounded size is multiplied within a task, block of columns by block of columns, and
   returns its components only. A larger group is split first: around the set R of what
   most members have, members are their differences d(x) = x ^ R, and |x ^ y| = |d(x)| +
   |d(y)| - 2 |d(x) & d(y)|. Linked x, y whose differences do not overlap are both linked
   with the member of least (den + num) * |d| - (den - num) * size; the others share a
   column of d and meet again in its group, which has at most half of the members.

No link between different texts is lost and no group is expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillrank.llm.arrays import frugal, lower_ascii, mix, shingles, text_chunks, word_tokens
from quillrank.llm.bits import bit_table, bits_for, in_table
from quillrank.llm.components import components
from quillrank.llm.frequency import Layout, counted, frequency
from quillrank.llm.shared import discard, small_batches, stored, table, unused

SMALL = 64  # sets that may meet pair by pair under one column
MOST_MEMBERS = 2048  # of a group that one task multiplies
MOST_CELLS = 1 << 21
_DENSE = 64  # columns with more members than this are multiplied as dense blocks
_BLOCK = 1024


@dataclass(frozen=True)
class Likeness:
    """Shingle size and the threshold num / den."""

    shingle: int = 5
    num: int = 80
    den: int = 100
    lower: bool = True

    def misses(self, n):
        """The most columns of a set of n that a linked set can lack or add together."""
        return (self.den - self.num) * (n + n * self.den // self.num) // (self.den + self.num)

    def misses_column(self, n: Column) -> Column:
        both = n + F.floor(n * self.den / self.num)
        return F.floor(both * (self.den - self.num) / (self.den + self.num))

    def linked(self, apart, n, m):
        """Whether sets of n and m that differ in `apart` columns are linked; for arrays and Columns."""
        return apart * (self.den + self.num) <= (n + m) * (self.den - self.num)


def _sets(batch: pa.RecordBatch, like: Likeness):
    """(row slice, set sizes, set of each document as sorted flat hashes, node id) per chunk."""
    for part, offsets, data in text_chunks(batch):
        tokens, first = word_tokens(lower_ascii(data) if like.lower else data, offsets)
        doc, grams = shingles(tokens, first, like.shingle)
        n = np.bincount(doc, minlength=part.num_rows).astype(np.int64)
        total = np.zeros(len(grams) + 1, dtype=np.uint64)
        np.cumsum(mix(grams + np.uint64(1)), out=total[1:])
        end = np.cumsum(n)
        yield part, n, doc, grams, mix(total[end] - total[end - n] + n.astype(np.uint64)).view(np.int64)


def shingle_frequency(docs: DataFrame, like: Likeness):
    """In how many documents each shingle occurs, as levels."""
    octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    layout = Layout.of(octets // 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return counted((grams for batch in batches for _, _, _, grams, _ in _sets(batch, like)), layout)

    return frequency(docs.select("text").mapInArrow(frugal(run), "range int, hashes binary"), layout)


def rare_cells(n: np.ndarray, doc: np.ndarray, grams: np.ndarray, occurs: np.ndarray, like: Likeness):
    """(document, shingle, place from the rarest) of the cells that linked documents must share one of."""
    need = like.misses(n) + 1
    lone = np.bincount(doc[occurs == 0], minlength=len(n))
    some = np.flatnonzero((lone < need)[doc] & (occurs > 0))
    some = some[np.lexsort((grams[some], occurs[some], doc[some]))]
    doc, grams = doc[some], grams[some]
    count = np.bincount(doc, minlength=len(n))
    place = np.arange(len(doc)) - (np.cumsum(count) - count)[doc] + lone[doc]
    keep = place < need[doc]
    return doc[keep], grams[keep], place[keep]


def incidence(docs: DataFrame, like: Likeness, occurs) -> DataFrame:
    """A row per document (doc_id, id, n, node) and a row per rare cell (column, node, n, place), in one pass.

    `node` names the set: equal sets have equal nodes, an empty set has none. A task gives
    the cells of a set once per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, doc, grams, node in _sets(batch, like):
                d, column, place = rare_cells(n, doc, grams, occurs.value.occurrences(grams), like)
                _, firsts = np.unique(node, return_index=True)
                once = np.zeros(len(node), dtype=bool)
                once[firsts] = True
                once = once[d]
                d, column, place = d[once], column[once], place[once]
                rows, cells = part.num_rows, len(d)
                names = ["doc_id", "id", "column", "place", "n", "node"]
                missing = [pa.nulls(cells, part.column(c).type) for c in names[:2]]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.concat_arrays([part.column(c), m]) for c, m in zip(names[:2], missing, strict=True)),
                        pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(column.view(np.int64))]),
                        pa.concat_arrays([pa.nulls(rows, pa.int32()), pa.array(place.astype(np.int32))]),
                        pa.array(np.concatenate((n, n[d]))),
                        pa.array(np.concatenate((node, node[d])), mask=np.concatenate((n == 0, np.zeros(cells, dtype=bool)))),
                    ],
                    names=names,
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("doc_id").alias("id"), "text").mapInArrow(frugal(run), f"doc_id {kind}, id long, column long, place int, n long, node long")


def candidate_pairs(cells: DataFrame, like: Likeness) -> DataFrame:
    """u, v, n, m of sets that meet under columns of at most SMALL sets and may be linked."""
    x = cells.select("column", F.col("node").alias("u"), F.col("n"), F.col("place").alias("i"))
    y = cells.select("column", F.col("node").alias("v"), F.col("n").alias("m"), F.col("place").alias("j"))
    sizes = F.least("n", "m") * like.den >= F.greatest("n", "m") * like.num
    pairs = x.join(y, "column").where((F.col("u") < F.col("v")) & sizes)
    pairs = pairs.groupBy("u", "v", "n", "m").agg(F.count("*").alias("common"), F.max("i").alias("i"), F.max("j").alias("j"))
    most = F.col("common") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1
    return pairs.where(like.linked(F.col("n") + F.col("m") - 2 * most, F.col("n"), F.col("m"))).select("u", "v")


def wanted_sets(docs: DataFrame, like: Likeness, ids, nodes) -> DataFrame:
    """node, grams (sorted) of the sets whose node is in the table `nodes`, once each; `ids` has a document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_table(ids.value, batch.column("id").to_numpy().view(np.uint64))))
            for _, n, _, grams, node in _sets(batch, like):
                ends = np.cumsum(n)
                take = np.flatnonzero((n > 0) & in_table(nodes.value, node.view(np.uint64)))
                take = take[np.unique(node[take], return_index=True)[1]]
                if len(take):
                    lists = pa.array([grams[ends[i] - n[i] : ends[i]].view(np.int64) for i in take], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(node[take]), lists], names=["node", "grams"])

    found = docs.select(F.xxhash64("doc_id").alias("id"), "text").mapInArrow(frugal(run), "node long, grams array<bigint>")
    return found.dropDuplicates(["node"])


def overlaps(count: np.ndarray, member: np.ndarray, column: np.ndarray) -> np.ndarray:
    """How many columns any two of the members share: a sparse product, dense where columns are."""
    k = len(count)
    out = np.zeros((k, k), dtype=np.float32)
    _, code, have = np.unique(column, return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    member, code = member[order], code[order]
    width = have[code]
    thin = (width > 1) & (width <= _DENSE)
    rows, cols = member[thin], code[thin]
    for step in range(1, _DENSE):
        meet = np.flatnonzero(cols[step:] == cols[:-step]) if len(cols) > step else np.zeros(0, np.int64)
        if not len(meet):
            break
        np.add.at(out, (rows[meet], rows[meet + step]), 1)
    out += out.T
    wide = np.flatnonzero(have > _DENSE)
    slot = np.full(len(have), -1, dtype=np.int64)
    slot[wide] = np.arange(len(wide))
    rows, cols = member[width > _DENSE], slot[code[width > _DENSE]]
    for begin in range(0, len(wide), _BLOCK):
        here = (cols >= begin) & (cols < begin + _BLOCK)
        block = np.zeros((k, _BLOCK), dtype=np.float32)
        block[rows[here], cols[here] - begin] = 1
        out += block @ block.T
    return out


def group_components(n: np.ndarray, count: np.ndarray, column: np.ndarray, like: Likeness) -> np.ndarray:
    """The least member that links reach, for each member (with `count` columns of `column` each)."""
    k = len(n)
    member = np.repeat(np.arange(k), count)
    apart = count[:, None] + count[None, :] - 2 * overlaps(count, member, column).astype(np.int64)
    linked = like.linked(apart, n[:, None], n[None, :])
    root = np.arange(k)
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], k).min(axis=1))
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


def small_group_links(groups: DataFrame, like: Likeness) -> DataFrame:
    """u, v: each member with the least member of its component, of groups that fit a task."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x, n = group["x"].to_numpy(), group["n"].to_numpy()
        lists = group["d"].combine_chunks()
        root = group_components(n, lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy(), like)
        own = root != np.arange(len(root))
        return pa.table({"u": x[own], "v": x[root[own]]})

    return groups.groupBy("group").applyInArrow(run, "u long, v long")


def _star(groups: DataFrame, like: Likeness) -> DataFrame:
    """u, v: links of each group's members with its centre."""
    weight = F.size("d") * (like.den + like.num) - F.col("n") * (like.den - like.num)
    centres = groups.groupBy("group").agg(F.min_by(F.struct("x", "n", "d"), F.struct(weight, F.col("x"))).alias("c"))
    apart = F.size("d") + F.size("c.d") - 2 * F.size(F.array_intersect("d", "c.d"))
    rows = groups.join(centres, "group").where(F.col("x") != F.col("c.x")).where(like.linked(apart, F.col("n"), F.col("c.n")))
    return rows.select(F.col("x").alias("u"), F.col("c.x").alias("v")).distinct()


def _split(groups: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """Links with the centre under the majority's reference, and the smaller groups that remain."""
    members = groups.groupBy("group").agg(F.count("*").alias("members"))
    counts = groups.select("group", F.explode("d").alias("column")).groupBy("group", "column").agg(F.count("*").alias("have"))
    # the reference takes over what most members have: d then names each member's own differences
    major = counts.join(members, "group").where("2 * have > members").groupBy("group").agg(F.collect_list("column").alias("major"))
    flipped = F.concat(F.array_except("d", "major"), F.array_except("major", "d"))
    rows = groups.join(major, "group", "left").withColumn("d", F.when(F.col("major").isNull(), F.col("d")).otherwise(flipped)).drop("major")
    rows = stored(rows, "jaccard-rows")
    star = stored(_star(rows, like), "jaccard-star", small=True)
    cells = rows.select("group", "x", "n", F.explode("d").alias("column"))
    counts = cells.groupBy("group", "column").agg(F.count("*").alias("have"))
    cells = cells.join(counts, ["group", "column"])
    # rarest first; a column that only one member has takes a place but meets nobody
    place = F.row_number().over(Window.partitionBy("group", "x").orderBy("have", "column"))
    cells = cells.withColumn("place", place).where((F.col("place") <= like.misses_column(F.col("n")) + 1) & (F.col("have") > 1))
    cells = cells.select("x", F.xxhash64("group", "column").alias("to"), "group")
    smaller = stored(cells.join(rows, ["group", "x"]).select(F.col("to").alias("group"), "x", "n", "d"), "jaccard-groups", small=True)
    discard(rows)
    return star, smaller


def group_links(groups: DataFrame, like: Likeness, most_members: int | None = None) -> list[DataFrame]:
    """Tables of u, v that connect what is linked within groups of (group, x, n, d); `groups` is a stored table."""
    found = []
    most_members = most_members or MOST_MEMBERS
    while True:
        sizes = groups.groupBy("group").agg(F.count("*").alias("members"), F.sum(F.size("d")).alias("cells"))
        fits = (F.col("members") <= most_members) & (F.col("cells") <= MOST_CELLS) | (F.col("members") <= 2)
        sizes = stored(sizes.where("members > 1").withColumn("fits", fits), "jaccard-sizes", small=True)
        fitting = groups.join(sizes.where("fits").select("group"), "group", "left_semi")
        found.append(stored(small_group_links(fitting, like), "jaccard-links", small=True))
        large = sizes.where("NOT fits").select("group")
        if large.isEmpty():
            discard(groups, sizes)
            return found
        star, smaller = _split(groups.join(large, "group", "left_semi"), like)
        discard(groups, sizes)
        found.append(star)
        groups = smaller


def links(docs: DataFrame, cells: DataFrame, named: DataFrame, like: Likeness) -> DataFrame:
    """u, v: links between nodes (different sets) that connect what the threshold connects."""
    spark = docs.sparkSession
    columns = cells.groupBy("column").agg(F.count("*").alias("have"), F.min("node").alias("least")).where("have > 1")
    cells = stored(cells.join(columns, "column"), "jaccard-cells", small=True)
    pairs = stored(candidate_pairs(cells.where(F.col("have") <= SMALL), like), "jaccard-pairs", small=True)
    crowds = stored(cells.where(F.col("have") > SMALL).select(F.col("least").alias("group"), F.col("node").alias("x"), "n").distinct(), "jaccard-crowds", small=True)
    discard(cells)
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(crowds.select(F.col("x").alias("node")))
    nodes = stored(nodes.distinct(), "jaccard-nodes", small=True)
    bits = bits_for(nodes.count())
    holders = named.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("key"))
    ids, wanted = (spark.sparkContext.broadcast(bit_table(t, bits)) for t in (holders.select("key"), nodes.select(F.col("node").alias("key"))))
    sets = stored(wanted_sets(docs, like, ids, wanted), "jaccard-sets", small=True)
    u, v = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"{c}_set")) for c in "uv")
    n, m = F.size("u_set"), F.size("v_set")
    apart = n + m - 2 * F.size(F.array_intersect("u_set", "v_set"))
    joined = pairs.join(u, "u").join(v, "v").where(like.linked(apart.cast("long"), n, m)).select("u", "v")
    found = [stored(joined, "jaccard-links", small=True)]
    groups = stored(crowds.join(sets.withColumnRenamed("node", "x"), "x").select("group", "x", "n", F.col("grams").alias("d")), "jaccard-groups", small=True)
    discard(pairs, crowds, nodes, sets)
    return reduce(DataFrame.unionByName, found + group_links(groups, like))


def classified(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, n, node (null for an empty set), group (a node of its component), component, class_size per row."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    small_batches(spark)
    occurs = spark.sparkContext.broadcast(shingle_frequency(docs, like))
    rows = stored(incidence(docs, like, occurs), "jaccard-rows")
    named = rows.where("column IS NULL").select("doc_id", "id", "n", "node")
    cells = rows.where("column IS NOT NULL").select("column", "node", "n", "place").distinct()
    classes = named.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size"))
    roots = components(links(docs, cells, named.where("node IS NOT NULL"), like), "jaccard-roots")
    least = classes.join(roots, "node").groupBy("root").agg(F.min("least").alias("component"))
    of_node = classes.join(roots.join(least, "root"), "node", "left")
    of_node = of_node.select("node", "class_size", F.coalesce("root", "node").alias("group"), F.coalesce("component", "least").alias("component"))
    return named.join(of_node, "node", "left")


def near_duplicates(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), class_size per row of `docs`.

    Sets that are equal form one class first, however many rows it has. A null or empty
    text has an empty set and is linked with nothing; a row with a null doc_id takes
    part in links and gets the smallest doc_id of its component (null if there is
    none); repeated rows are equal sets and share a component. A text of any length is one
    set. An empty table gives an empty result; other columns of `docs` are not read.
    """
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    rows = classified(docs, like)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def deduplicated(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """`docs` with one row of each component: the smallest doc_id (null last), of repeated rows any one.

    Different texts under one doc_id are judged each by itself. Rows without words stay.
    Only documents whose doc_id is concerned are read again word by word and shuffled;
    the others pass by.
    """
    spark = docs.sparkSession
    found = stored(classified(docs, like).where("node IS NOT NULL").select("doc_id", "id", "node", "group"), "jaccard-found", small=True)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    kept = found.groupBy("group").agg(F.count("*").alias("rows"), F.min(order).alias("kept")).where("rows > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("node") == F.col("kept.node"))
    judged = stored(found.join(kept, "group").select("id", "node", stays.alias("stays")).distinct(), "jaccard-judged", small=True)
    discard(found)
    bits = bits_for(judged.count())
    concerned = spark.sparkContext.broadcast(bit_table(judged.select(F.col("id").alias("key")).distinct(), bits))
    taken = set(docs.columns)
    key, node, verdict = (unused(c, taken) for c in ("id", "node", "stays"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id"))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~in_table(concerned.value, batch.column(key).to_numpy().view(np.uint64))))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_table(concerned.value, batch.column(key).to_numpy().view(np.uint64))))
            for part, n, _, _, own in _sets(batch, like):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, mask=n == 0)], names=[*part.schema.names, node])

    untouched = keyed.mapInArrow(frugal(passing), keyed.schema).select(*docs.columns)
    touched = keyed.mapInArrow(frugal(named), StructType([*keyed.schema.fields, StructField(node, LongType())]))
    judged = judged.select(F.col("id").alias(key), F.col("node").alias(node), F.col("stays").alias(verdict))
    touched = touched.join(judged, [key, node], "left")
    alone = touched.where(F.col(verdict).isNull())
    chosen = touched.where(F.col(verdict)).dropDuplicates([key, node])
    return untouched.unionByName(alone.select(*docs.columns)).unionByName(chosen.select(*docs.columns))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Likeness(3, 90, 100)).select("doc_id", "n_shingles", "component_id")


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
cells AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle FROM words, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS t(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM cells GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM cells a JOIN cells b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM met JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * common >= 90 * (x.n + y.n - common)),
steps AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reached(u, v) AS (SELECT u, v FROM steps UNION SELECT r.u, s.v FROM reached r JOIN steps s ON r.v = s.u),
least AS (SELECT u, min(v) AS v FROM reached GROUP BY u)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.v, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.u = d.doc_id
"""
