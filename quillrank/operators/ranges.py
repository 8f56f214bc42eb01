"""Order at scale: positions, running values, order statistics and k of n without a task per key.

A window over a whole key sorts that key in one task. Here rows are dealt by ranges of
(key, order), so a key of any size spreads over as many partitions as it needs; each part
is numbered by itself, and what lies before it (one row per part that goes on with a key
of the part before, so never more rows than partitions) is broadcast and added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrank.sources.tables import stored


def dealt(df: DataFrame, *order: Column | str, part: str = "_part") -> DataFrame:
    """`df` as a stored table, range-partitioned by `order`, with the number of its range in `part`.

    Stored, since the cuts of a range partitioning are drawn anew each time it runs.
    """
    return stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], position: str | None = "pos", values: dict[str, tuple[str, str]] | None = None, table: DataFrame | None = None) -> DataFrame:
    """`df` with the row's number within `keys` (from 1) and running values up to and with it.

    `values` maps new columns to (aggregate, column), the aggregate `sum` or `bit_xor`;
    `order` must tell the rows of a key apart, or equal rows are numbered in any order.
    `table`, if given, is what dealt(df, *keys, *order) has returned.
    """
    values = values or {}
    combine = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    columns = df.columns
    rows = table if table is not None else dealt(df, *keys, *order)
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), *(F.expr(f"{how}(`{c}`)").alias(f"_{name}") for name, (how, c) in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_part").alias("_in"), F.sum("_n").over(earlier).alias("_n"), *(F.expr(f"{how}(_{name})").over(earlier).alias(f"_{name}") for name, (how, _) in values.items()))
    before = F.broadcast(before.where("_n IS NOT NULL"))  # one row for each part that goes on with a key, at most
    made = rows.withColumn("_at", F.row_number().over(inside))
    for name, (how, c) in values.items():
        made = made.withColumn(name, F.expr(f"{how}(`{c}`)").over(inside))
    same = F.col("_part") == F.col("_in")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    joined = made.join(before, same, "left")
    out = [F.col(c) for c in columns if c not in values]
    if position:
        out.append((F.col("_at") + F.coalesce("_n", F.lit(0))).alias(position))
    out += [F.when(F.col("_n").isNull(), F.col(name)).otherwise(combine[how](F.coalesce(F.col(name), F.lit(0)), F.coalesce(F.col(f"_{name}"), F.lit(0)))).alias(name) for name, (how, _) in values.items()]
    return joined.select(*out)


#: Sizes from which counts narrow a range: rows of a range that one task sorts without trouble.
RANGE_ROWS = 1 << 20
#: Cuts per key in each round of counts.
CUTS = 1 << 8


def at_ranks(df: DataFrame, value: str, key: str, ranks: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(key, i, value): the i-th smallest value (from 0) of each key, for `ranks` of key and i.

    Values (numbers) are counted in ranges between approximate cuts of their key, which
    are drawn in one pass and have no say in the result: the counts tell which range holds
    a rank, and only the rows of those ranges are numbered. Nulls are left out, NaN is the
    largest; keys without values give nothing. `ranks` holds some ranks per key.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(value).alias("_v")).where("_v IS NOT NULL")
    cuts = rows.groupBy("_k").agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", F.array(*(F.lit(i / CUTS) for i in range(1, CUTS))), F.lit(10 * CUTS)))).alias("_cuts"))
    cut = rows.join(cuts.withColumnRenamed("_k", "_c"), F.col("_k").eqNullSafe(F.col("_c")))
    # a value that is a cut has an odd range of its own, so ties of any number are told by counts alone
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    is_cut = F.array_contains("_cuts", F.col("_v")).cast("int")
    cut = cut.select("_k", "_v", (2 * below + is_cut).alias("_r"))
    counts = cut.groupBy("_k", "_r").agg(F.count("*").alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))  # 2 * CUTS rows a key at most
    before = F.coalesce(F.sum("_m").over(Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = ranks.select(F.col(key).alias("_c"), F.col("i"))
    found = counts.withColumn("_before", before).join(asked, F.col("_k").eqNullSafe(F.col("_c")) & F.col("i").between(F.col("_before"), F.col("_before") + F.col("_m") - 1))
    found = found.select("_k", "_r", "i", "_before", "_low", "_high")
    known = found.where("_low <=> _high").select(F.col("_k").alias(key), "i", F.col("_low").alias(value))
    open_ranges = found.where("NOT (_low <=> _high)")
    wanted = open_ranges.select(F.col("_k").alias("_c"), F.col("_r").alias("_s"), "_before").distinct()
    inside = cut.join(wanted, F.col("_k").eqNullSafe(F.col("_c")) & (F.col("_r") == F.col("_s"))).select("_k", "_r", "_v", "_before")
    # distinct values with their numbers: ties add up before they are ordered
    inside = inside.groupBy("_k", "_r", "_before", "_v").agg(F.count("*").alias("_m"))
    numbered = running(inside, ["_k", "_r"], [F.col("_v")], None, {"_until": ("sum", "_m")})
    picked = numbered.join(open_ranges.select(F.col("_k").alias("_c"), F.col("_r").alias("_s"), "i"), F.col("_k").eqNullSafe(F.col("_c")) & (F.col("_r") == F.col("_s")) & (F.col("i") < F.col("_before") + F.col("_until")) & (F.col("i") >= F.col("_before") + F.col("_until") - F.col("_m")))
    return known.unionByName(picked.select(F.col("_k").alias(key), "i", F.col("_v").alias(value)))


def nearest_rank(df: DataFrame, value: str, q: float, key: str) -> DataFrame:
    """pct: sorted[round(q * (n - 1))] with half-to-even rounding, per key."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    ranks = sizes.select(key, F.bround(F.lit(q) * (F.col("_n") - 1)).cast("long").alias("i"))
    return at_ranks(df, value, key, ranks).select(key, F.col(value).alias("pct"))


def percentiles(df: DataFrame, value: str, key: str, qs: dict[str, float]) -> DataFrame:
    """key and a column per percentile, with linear interpolation between the two nearest ranks."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    place = sizes.select("_k", F.explode(F.create_map(*(F.lit(x) for pair in qs.items() for x in pair))).alias("_name", "_q"), "_n").withColumn("_at", F.col("_q") * (F.col("_n") - 1))
    both = place.select("_k", "_name", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("i"))
    values = at_ranks(df, value, key, both.select(F.col("_k").alias(key), "i").distinct()).select(F.col(key).alias("_own"), F.col("i").alias("_i"), F.col(value).cast("double").alias("_v"))
    named = both.join(values, F.col("_k").eqNullSafe(F.col("_own")) & (F.col("i") == F.col("_i"))).select("_k", "_name", "_at", "i", "_v")
    low, high = F.min_by("_v", "i"), F.max_by("_v", "i")
    found = named.groupBy("_k", "_name").agg((low + (high - low) * (F.first("_at") - F.floor(F.first("_at")))).alias("_v"))
    return found.groupBy(F.col("_k").alias(key)).agg(*(F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in qs))


def _keyed(df: DataFrame, want: dict[str, int], digest: Column, id_: Column, key: Column | None) -> DataFrame:
    """`df` with _key, _k (rows asked for of the key), _digest and _id."""
    asked = F.create_map(*(F.lit(x) for name, n in want.items() for x in (name, int(n))))
    rows = df.withColumn("_key", F.lit("") if key is None else F.coalesce(key.cast("string"), F.lit("\0"))).withColumn("_digest", digest).withColumn("_id", id_)
    return rows.withColumn("_k", F.coalesce(F.element_at(asked, F.col("_key")), F.lit(0)))


def last_by_hash(df: DataFrame, k: int | dict, digest: Column, id_: Column, key: Column | None = None, digits: int = 5) -> DataFrame:
    """_own (key), _last (digest and id): the k-th row in order of (digest, id) of each key; no row where there are fewer.

    `digest` is a hex string. Counts of its first `digits` digits (16 ** digits numbers per
    key at most) show in which of them the k-th row lies, and only the rows of that one
    prefix are ordered.
    """
    want = {"": k} if key is None else {str(name): n for name, n in k.items()}
    hashes = _keyed(df, want, digest, id_, key).where("_k > 0").select("_key", "_k", "_digest", "_id", F.substring("_digest", 1, digits).alias("_prefix"))
    counts = hashes.groupBy("_key", "_k", "_prefix").agg(F.count("*").alias("_n"))
    until = F.sum("_n").over(Window.partitionBy("_key").orderBy("_prefix"))
    edges = counts.withColumn("_until", until).where("_until - _n < _k AND _until >= _k").select(F.col("_key").alias("_c"), F.col("_prefix").alias("_edge"), (F.col("_k") - (F.col("_until") - F.col("_n"))).alias("_rest"))
    edge = hashes.join(F.broadcast(edges), (F.col("_key") == F.col("_c")) & (F.col("_prefix") == F.col("_edge")))  # one row per key asked for
    at = F.row_number().over(Window.partitionBy("_key").orderBy("_digest", "_id"))
    return edge.withColumn("_at", at).where("_at = _rest").select(F.col("_key").alias("_own"), F.struct("_digest", "_id").alias("_last"))


def marked_by_hash(df: DataFrame, k: int | dict, digest: Column, id_: Column, key: Column | None = None, mark: str = "chosen", digits: int = 5, source: DataFrame | None = None) -> DataFrame:
    """`df` with `mark`: true for the k rows of smallest (digest, id), per `key` if given (then `k` maps keys to numbers).

    The k-th row (last_by_hash(); one per key, broadcast) marks all others in one scan. It
    is sought in `source`, if given: a frame of the same rows with a shorter plan.
    """
    want = {"": k} if key is None else {str(name): n for name, n in k.items()}
    if not want:
        return df.withColumn(mark, F.lit(False))
    last = last_by_hash(df if source is None else source, k, digest, id_, key, digits)
    told = _keyed(df, want, digest, id_, key).join(F.broadcast(last), F.col("_key") == F.col("_own"), "left")
    return told.select(*df.columns, ((F.col("_k") > 0) & (F.col("_last").isNull() | (F.struct("_digest", "_id") <= F.col("_last")))).alias(mark))


def first_by_hash(df: DataFrame, k: int | dict, digest: Column, id_: Column, key: Column | None = None, digits: int = 5) -> DataFrame:
    """The rows that marked_by_hash() marks."""
    return marked_by_hash(df, k, digest, id_, key, "_chosen", digits).where("_chosen").drop("_chosen")
