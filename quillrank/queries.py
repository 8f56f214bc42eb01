"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrank.functions import exprs as X
from quillrank.functions import lexicon as L
from quillrank.functions import rewrite
from quillrank.functions.policy import Policy
from quillrank.operators import audit
from quillrank.operators import evaluate as E
from quillrank.operators import features as FE
from quillrank.operators import adversarial, boosting, explain, labeling, postings, retrieval, scoring, trees
from quillrank.sources import vectors
from quillrank.sources.entities import raw_schema, read_accounted, read_upload, typed
from quillrank.sources.store import latest, load, read_ranking, remaining, save, write_ranking
from quillrank.sources.tables import shared_folder, stored
from quillrank.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TERMS = ["the", "license", "die", "que"]
BM25_QUERY = "the license que license die"
REF = "2001-08-01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _sql_term(column: str, term: str) -> str:
    return f"regexp_matches(lower({column}), '{L.pattern(term)}')"


_ANY = " OR ".join(_sql_term("text", t) for t in TERMS)
_COUNT = " + ".join(f"{_sql_term('text', t)}::INT" for t in TERMS)


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars > 200")
def scan_project(spark, d):
    return read(spark, d, "documents").where("n_chars > 200").select("doc_id", "lang", "source", "n_chars")


@query(f"SELECT doc_id, ({_ANY}) AS any_term, ({_COUNT})::INT AS n_terms, len(regexp_extract_all(lower(text), '{L.TOKEN}'))::INT AS n_tokens FROM documents")
def lexicon_signals(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", L.any_of(t, TERMS).alias("any_term"), L.count_of(t, TERMS).alias("n_terms"), F.size(L.tokens(t)).alias("n_tokens"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '1') THEN 'one' WHEN regexp_matches(lower(p_name), '2|3') THEN 'few' ELSE 'other' END AS bucket,
  greatest(0.5::DOUBLE, CASE WHEN contains(lower(p_type), 'eco') THEN 0.3::DOUBLE END, CASE WHEN contains(lower(p_type), 'pro') THEN 0.9::DOUBLE END, CASE WHEN contains(lower(p_type), 'a') THEN 0.7::DOUBLE END) AS level FROM part""")
def title_bucket(spark, d):
    levels = {"eco": 0.3, "pro": 0.9, "a": 0.7}
    return read(spark, d, "part").select("p_partkey", L.bucket(F.col("p_name"), {"one": ["1"], "few": ["2", "3"]}, "other").alias("bucket"), L.seniority(F.col("p_type"), levels).alias("level"))


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_split_to_array(text, '[.;]')[1], '\\s+', ' ', 'g')) AS c FROM documents)
SELECT doc_id, CASE WHEN length(c) > 0 AND len(string_split(c, ' ')) >= 4 THEN array_to_string(string_split(c, ' ')[1:14], ' ') END AS clause FROM c""")
def first_clause(spark, d):
    return read(spark, d, "documents").select("doc_id", L.first_clause(F.col("text")).alias("clause"))


_BM25 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{L.TOKEN}') AS w FROM documents),
tot AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM w),
df AS (SELECT term, count(*)::DOUBLE AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM w) GROUP BY term),
voc AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df, tot),
m AS (SELECT avg(idf) AS m FROM voc),
q(term, times) AS (VALUES ('the', 1), ('license', 2), ('que', 1), ('die', 1)),
wt AS (SELECT term, times * CASE WHEN idf < 0 THEN 0.25::DOUBLE * m ELSE idf END AS weight FROM voc JOIN q USING (term), m),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) JOIN q USING (term) GROUP BY ALL),
s AS (SELECT tf.doc_id, sum(weight * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w.w) / avgdl))) AS s FROM tf JOIN wt USING (term) JOIN w USING (doc_id), tot GROUP BY tf.doc_id),
bm AS (SELECT doc_id, coalesce(s, 0::DOUBLE) AS bm25 FROM documents LEFT JOIN s USING (doc_id))
"""


def _bm25(spark, d):
    return retrieval.bm25(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", BM25_QUERY.split())


@query(_BM25 + "SELECT doc_id, round(bm25, 6) AS bm25 FROM bm")
def bm25_all(spark, d):
    return _bm25(spark, d).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(_BM25 + "SELECT doc_id, round(bm25, 6) AS bm25 FROM bm ORDER BY round(bm25, 6) DESC, doc_id LIMIT 50")
def bm25_topk(spark, d):
    return bm25_all(spark, d).orderBy(F.desc("bm25"), "doc_id").limit(50)


_ASKED = {"first": "the license que license die", "second": "warranty license", "third": "die und que", "fourth": "zzzz"}


def _of_query(text: str) -> str:
    """The BM25 SQL for another query."""
    times = {t: text.split().count(t) for t in text.split()}
    return _BM25.replace("VALUES ('the', 1), ('license', 2), ('que', 1), ('die', 1)", "VALUES " + ", ".join(f"('{t}', {n})" for t, n in times.items()))


@query(" UNION ALL ".join(f"SELECT '{name}' AS query, * FROM ({_of_query(text)} SELECT doc_id, round(bm25, 6) AS bm25 FROM bm ORDER BY round(bm25, 6) DESC, doc_id LIMIT 20)" for name, text in _ASKED.items()))
def bm25_index(spark, d):
    """Several queries from one stored index: the corpus is tokenised once."""
    index = postings.build(read(spark, d, "documents"), "doc_id", "text", work_path(spark, "postings"))
    found = [postings.top_k(index, text.split(), 20, digits=6).select(F.lit(name).alias("query"), F.col("key").alias("doc_id"), "bm25") for name, text in _ASKED.items()]
    return reduce(DataFrame.unionByName, found)


_UPLOADS = 3


@query(" UNION ALL ".join(f"SELECT {u} AS upload, * FROM ({_BM25.replace('documents', f'(SELECT * FROM documents WHERE doc_id % {_UPLOADS} = {u})')} SELECT doc_id, round(bm25, 6) AS bm25 FROM bm)" for u in range(_UPLOADS)))
def live_bm25(spark, d):
    """Uploads that arrive one after the other; each is scored with its own statistics, by a query that starts again from its checkpoint."""
    path = work_path(spark, "live-bm25")
    docs = read(spark, d, "documents").select("doc_id", "text")
    for upload in range(_UPLOADS):
        docs.where(F.col("doc_id") % _UPLOADS == upload).write.mode("append").json(f"{path}/in")
        arriving = spark.readStream.schema("doc_id long, text string").json(f"{path}/in")
        live.run_available(arriving, lambda batch: retrieval.bm25(batch, "doc_id", "text", BM25_QUERY.split()), f"{path}/out", f"{path}/checkpoint")
    return live.kept(spark, f"{path}/out").select((F.col("doc_id") % _UPLOADS).cast("int").alias("upload"), "doc_id", F.round("bm25", 6).alias("bm25"))


def _replayed(spark, d, path: str, slices: int, work, mode: str):
    """`events` in order of time, in so many arrivals, each taken by a query that starts again from its checkpoint."""
    events = read(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    low, high = events.agg(F.min("at"), F.max("at")).first()
    for i in range(slices):
        first, last = (low + (high - low) * k // slices for k in (i, i + 1))
        arrived = events.where((F.col("at") >= first if i == 0 else F.col("at") > first) & (F.col("at") <= last))
        arrived.write.mode("append").json(f"{path}/in")
        stream = spark.readStream.schema("event_id long, user_id long, event_type string, value double, at long").json(f"{path}/in")
        stream = stream.withColumn("ts", F.timestamp_micros("at")).drop("at")
        work(stream, mode)


@query("""WITH s AS (SELECT c_custkey, (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS level FROM customer)
SELECT event_id, user_id, round(0.6::DOUBLE * least(1, greatest(0, value / 100.0::DOUBLE)) + 0.4::DOUBLE * coalesce(level, 0), 6) AS score FROM events LEFT JOIN s ON c_custkey = user_id""")
def live_scores(spark, d):
    """Events scored as they arrive, against a snapshot of the customers that is frozen when the query starts."""
    path = work_path(spark, "live-scores")
    customers = read(spark, d, "customer")
    stats = F.broadcast(X.min_max_stats(customers, "c_acctbal"))  # one row
    level = X.min_max(F.col("c_acctbal"), F.col("c_acctbal_low"), F.col("c_acctbal_high"))
    snapshot = stored(customers.crossJoin(stats).select(F.col("c_custkey").alias("user_id"), level.alias("level")), "snapshot")
    score = 0.6 * X.clamp(F.col("value") / 100.0) + 0.4 * F.coalesce("level", F.lit(0.0))
    work = live.scored_against(snapshot, "user_id", score)
    _replayed(spark, d, path, 3, lambda stream, mode: live.run_available(stream, work, f"{path}/out", f"{path}/checkpoint", mode), "append")
    return live.kept(spark, f"{path}/out").select("event_id", "user_id", F.round("score", 6).alias("score"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def live_latest(spark, d):
    """The last event of each user, kept in state per day while the watermark lets it."""
    path = work_path(spark, "live-latest")

    def work(stream, mode):
        latest_rows = live.latest_stream(stream, "user_id", "ts", ["ts", "event_id"])
        live.run_available(latest_rows, lambda batch: batch, f"{path}/out", f"{path}/checkpoint", mode)

    _replayed(spark, d, path, 4, work, "update")
    return live.latest_kept(live.kept(spark, f"{path}/out"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


_TOKENS = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{L.TOKEN}')) AS w FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS place, CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END AS sign FROM w),
v AS (SELECT doc_id, place, sum(sign)::DOUBLE AS x FROM h GROUP BY ALL), u AS (SELECT doc_id, place, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 0) AS x FROM v)"""


@query(f"WITH {_TOKENS}, a AS (SELECT place, x FROM u WHERE doc_id = (SELECT min(doc_id) FROM documents)) SELECT doc_id, round(coalesce(s, 0), 6) + 0 AS cosine FROM documents LEFT JOIN (SELECT doc_id, sum(u.x * a.x) AS s FROM u JOIN a USING (place) GROUP BY doc_id) USING (doc_id)")
def hashed_cosine(spark, d):
    """Hashed vectors of all documents against that of the first one."""
    docs = read(spark, d, "documents")
    vectors = retrieval.hashed(docs, "doc_id", "text")
    first = retrieval.hashed(docs.orderBy("doc_id").limit(1), "doc_id", "text").select(F.col("vector").alias("anchor"))
    return vectors.crossJoin(F.broadcast(first)).select("doc_id", (F.round(X.dot(F.col("vector"), F.col("anchor")), 6) + 0.0).alias("cosine"))


@query(_BM25 + f"""SELECT doc_id, naive_rank, bm_rank, naive_rank - bm_rank AS rank_delta FROM (
  SELECT doc_id, row_number() OVER (ORDER BY b DESC, doc_id) AS bm_rank, row_number() OVER (ORDER BY n DESC, doc_id) AS naive_rank
  FROM (SELECT bm.doc_id, round(bm25, 6) AS b, ({_COUNT}) AS n FROM bm JOIN documents USING (doc_id) ORDER BY round(bm25, 6) DESC, bm.doc_id LIMIT 100))""")
def keyword_vs_engine(spark, d):
    naive = read(spark, d, "documents").select("doc_id", L.count_of(F.col("text"), TERMS).alias("n"))
    top = bm25_all(spark, d).orderBy(F.desc("bm25"), "doc_id").limit(100).join(naive, "doc_id", "left")
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "doc_id"))  # noqa: E731  over the 100 best
    return top.select("doc_id", rank("n").alias("naive_rank"), rank("bm25").alias("bm_rank")).withColumn("rank_delta", F.col("naive_rank") - F.col("bm_rank"))


_RANKED = _BM25 + f"""SELECT doc_id, naive_rank, bm_rank, naive_rank - bm_rank AS rank_delta FROM (
  SELECT doc_id, row_number() OVER (ORDER BY b DESC, doc_id) AS bm_rank, row_number() OVER (ORDER BY n DESC, doc_id) AS naive_rank
  FROM (SELECT bm.doc_id, round(bm25, 6) AS b, ({_COUNT}) AS n FROM bm JOIN documents USING (doc_id) ORDER BY round(bm25, 6) DESC, bm.doc_id LIMIT 100))"""


@query(f"SELECT 'up' AS moved, doc_id, rank_delta FROM (SELECT * FROM ({_RANKED}) ORDER BY rank_delta DESC, doc_id LIMIT 3) UNION ALL SELECT 'down', doc_id, rank_delta FROM (SELECT * FROM ({_RANKED}) ORDER BY rank_delta, doc_id LIMIT 3)")
def movers(spark, d):
    """Whom the engine lifts and lowers most against the naive order."""
    return audit.movers(keyword_vs_engine(spark, d), "rank_delta", "doc_id", 3)


@query("""WITH a AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(range(1, 65)) t(i) WHERE label IN (0, 1) GROUP BY ALL),
n AS (SELECT label, sqrt(sum(m * m)) AS n FROM a GROUP BY label), u AS (SELECT label, i, m / n AS x FROM a JOIN n USING (label)),
s AS (SELECT vec_id, sum(CASE WHEN u.label = 0 THEN embedding[i]::DOUBLE * x ELSE 0 END) AS p, sum(CASE WHEN u.label = 1 THEN embedding[i]::DOUBLE * x ELSE 0 END) AS q FROM embeddings, u GROUP BY vec_id)
SELECT vec_id, round(p, 6) AS sim_pos, round(q, 6) AS sim_neg, round(p - q, 6) AS margin FROM s""")
def dense_margin(spark, d):
    e = read(spark, d, "embeddings")
    anchor = lambda k: retrieval.mean_vector(e.where(F.col("label") == k), "embedding")
    out = retrieval.dense_features(e, "embedding", anchor(0), anchor(1))
    return out.select("vec_id", *(F.round(c, 6).alias(n) for c, n in (("dense_sim_pos", "sim_pos"), ("dense_sim_neg", "sim_neg"), ("dense_margin", "margin"))))


@query("""WITH p AS (SELECT vec_id, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM p)
SELECT vec_id, round(v[1] / n, 6) AS first_value, round(v[16] / n, 6) AS last_value FROM n""")
def vector_prefix(spark, d):
    v = X.prefix(F.col("embedding"), 16)
    return read(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.col("v")[0], 6).alias("first_value"), F.round(F.col("v")[15], 6).alias("last_value"))


@query(f"""SELECT o_orderkey, datediff('month', o_orderdate::DATE, DATE '{REF}')::INT AS month_gap, datediff('day', o_orderdate::DATE, DATE '{REF}')::INT AS day_gap,
  round(CASE WHEN datediff('day', o_orderdate::DATE, DATE '{REF}') <= 30 THEN 1::DOUBLE WHEN datediff('day', o_orderdate::DATE, DATE '{REF}') >= 365 THEN 0.35::DOUBLE
    ELSE 1 - 0.65::DOUBLE * (datediff('day', o_orderdate::DATE, DATE '{REF}') - 30) / 335.0::DOUBLE END, 6) AS recency FROM orders""")
def date_gaps(spark, d):
    start = X.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd"))
    ref = F.to_date(F.lit(REF))
    days = F.datediff(ref, start)
    return read(spark, d, "orders").select("o_orderkey", X.months(start, ref).alias("month_gap"), days.alias("day_gap"), F.round(FE.recency(days), 6).alias("recency"))


_HISTORY = f"""h AS (SELECT o_custkey AS id, count(*)::DOUBLE AS n_roles, sum(o_orderkey % 40)::DOUBLE AS months, sum(CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey % 40 ELSE 0 END)::DOUBLE AS applied,
  min(CASE WHEN o_orderpriority LIKE '1%' THEN datediff('month', o_orderdate::DATE, DATE '{REF}') END) AS gap, max((o_orderstatus = 'F')::INT)::DOUBLE AS any_f FROM orders GROUP BY o_custkey)"""


def _histories(spark, d):
    """Orders as a career array per customer; a customer has at most some dozen."""
    role = F.struct((F.col("o_orderkey") % 40).cast("int").alias("months"), F.col("o_orderpriority").startswith("1").alias("related"), X.months(F.to_date("o_orderdate"), F.to_date(F.lit(REF))).alias("gap"), (F.col("o_orderstatus") == "F").alias("f"))
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(role).alias("career"))


@query(f"WITH {_HISTORY} SELECT id, n_roles, months / n_roles AS avg_tenure, applied / 12 AS applied_years, CASE WHEN months > 0 THEN applied / months ELSE 0 END AS share, coalesce(gap / 12.0::DOUBLE, 99::DOUBLE) AS years_since, any_f, (n_roles >= 4 AND months / n_roles < 18)::INT::DOUBLE AS chaser FROM h")
def history_folds(spark, d):
    c = F.col("career")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, e: s + e["months"])
    related = F.filter(c, lambda e: e["related"])
    n, months, applied = F.size(c).cast("double"), total(c), total(related)
    gap = F.array_min(F.transform(related, lambda e: e["gap"]))
    return _histories(spark, d).select(
        "id", n.alias("n_roles"), (months / n).alias("avg_tenure"), (applied / 12).alias("applied_years"), X.ratio(applied, months).alias("share"),
        F.coalesce(gap / 12, F.lit(99.0)).alias("years_since"), F.exists(c, lambda e: e["f"]).cast("double").alias("any_f"), ((n >= 4) & (months / n < 18)).cast("double").alias("chaser"),
    )


@query("""SELECT l_orderkey, l_linenumber, round(least(1::DOUBLE, greatest(0::DOUBLE, 0.15::DOUBLE + 0.85::DOUBLE * exp(-pow(l_quantity - 7, 2) / 18.0::DOUBLE))), 6) AS fit,
  round(w * (0.4::DOUBLE + 0.4::DOUBLE * ln(1 + least(l_quantity, 120)) / ln(121::DOUBLE) + 0.2::DOUBLE * ln(1 + least(p_size::DOUBLE, 100)) / ln(101::DOUBLE)), 6) AS trust,
  round(greatest(0::DOUBLE, w - l_discount * 10), 6) AS over_claim
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 0.8::DOUBLE WHEN 'N' THEN 1::DOUBLE ELSE 0.4::DOUBLE END AS w FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def skill_trust(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    weight = F.coalesce(F.element_at(F.create_map(F.lit("A"), F.lit(0.8), F.lit("N"), F.lit(1.0)), F.col("l_returnflag")), F.lit(0.4))
    used = lambda x, top: F.log1p(F.least(x.cast("double"), F.lit(float(top)))) / F.log1p(F.lit(float(top)))
    trust = weight * (0.4 + 0.4 * used(F.col("l_quantity"), 120) + 0.2 * used(F.col("p_size"), 100))
    return rows.select("l_orderkey", "l_linenumber", F.round(X.clamp(0.15 + 0.85 * X.gauss(F.col("l_quantity"), 7.0, 3.0)), 6).alias("fit"), F.round(trust, 6).alias("trust"), F.round(F.greatest(F.lit(0.0), weight - F.col("l_discount") * 10), 6).alias("over_claim"))


_BEHAVIOUR = """b AS (SELECT c_custkey AS id, CASE WHEN n IS NULL OR c_custkey % 3 = 0 THEN -1::DOUBLE ELSE n / 100.0::DOUBLE END AS rate, last FROM customer
  LEFT JOIN (SELECT user_id, count(*) AS n, max(ts)::DATE AS last FROM events GROUP BY user_id) ON user_id = c_custkey),
bf AS (SELECT id, CASE WHEN last IS NULL THEN 0.5::DOUBLE WHEN datediff('day', last, DATE '2024-03-15') <= 30 THEN 1::DOUBLE WHEN datediff('day', last, DATE '2024-03-15') >= 365 THEN 0.35::DOUBLE
    ELSE 1 - 0.65::DOUBLE * (datediff('day', last, DATE '2024-03-15') - 30) / 335.0::DOUBLE END AS recency, CASE WHEN rate < 0 THEN 0.5::DOUBLE ELSE least(1::DOUBLE, rate) END AS offer,
  least(1::DOUBLE, greatest(0::DOUBLE, rate)) AS interview, coalesce(datediff('day', last, DATE '2024-03-15')::DOUBLE, -1::DOUBLE) AS days FROM b)"""


def _behaviour(spark, d):
    seen = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").cast("date").alias("last"))
    rows = read(spark, d, "customer").join(seen, F.col("c_custkey") == F.col("user_id"), "left")
    rate = F.when(F.col("n").isNull() | (F.col("c_custkey") % 3 == 0), F.lit(-1.0)).otherwise(F.col("n") / 100.0)
    days = F.datediff(F.to_date(F.lit("2024-03-15")), F.col("last"))
    return rows.select(F.col("c_custkey").alias("id"), FE.recency(days).alias("recency"), FE.neutral_if_negative(rate).alias("offer"), X.clamp(rate).alias("interview"), F.coalesce(days.cast("double"), F.lit(-1.0)).alias("days"))


@query(f"WITH {_BEHAVIOUR} SELECT id, round(recency, 6) AS recency, round(offer, 6) AS offer, round(interview, 6) AS interview, days FROM bf")
def behaviour(spark, d):
    return _behaviour(spark, d).select("id", *(F.round(c, 6).alias(c) for c in ("recency", "offer", "interview")), "days")


@query(f"""WITH {_HISTORY} SELECT id, ((months > 12 * (id % 20) + 6 AND id % 20 > 0)::INT + (gap + 18 < 12 * (id % 20))::INT)::INT AS hard FROM (SELECT id, months, coalesce(gap, 1000000) AS gap FROM h)""")
def consistency(spark, d):
    c, years = F.col("career"), F.col("id") % 20
    months = F.aggregate(c, F.lit(0.0), lambda s, e: s + e["months"])
    gap = F.coalesce(F.array_min(F.transform(F.filter(c, lambda e: e["related"]), lambda e: e["gap"])), F.lit(1000000))
    hard = ((months > 12 * years + 6) & (years > 0)).cast("int") + (gap + 18 < 12 * years).cast("int")
    return _histories(spark, d).select("id", hard.alias("hard"))


#: Words that a role's description holds, by the number of its order: (condition, word).
_SAID = (("k % 7 = 0", "gauge archive"), ("k % 11 = 0", "unit hydrograph"), ("k % 13 = 0", "skill score"), ("k % 9 = 0", "river"), ("k % 10 = 0", "basin"), ("k % 6 = 1", "aquifer"), ("k % 5 = 2", "acoustics"), ("k % 16 = 3", "telescope"), ("k % 12 = 5", "spreadsheet macro"), ("k % 14 = 1", "kriging"), ("k % 17 = 0", "telemetry"), ("k % 15 = 4", "some 12 gb a day"))
_SKILLS = ("groundwater", "snowmelt", "excel", "filing", "river gauging")
_ROLES = f"""roles AS (SELECT o_custkey AS id, o_orderkey AS k, o_orderkey % 40 AS months, substr(o_orderpriority, 1, 1) AS kind, (o_orderkey % 3 = 0 OR o_custkey % 9 = 0) AS services, o_orderkey % 4 = 0 AS open, o_orderdate::DATE AS start,
  CASE WHEN o_orderkey % 4 = 0 THEN DATE '{REF}' ELSE o_orderdate::DATE + (o_orderkey % 900)::INT END AS fin FROM orders),
dated AS (SELECT *, kind IN ('1', '3') AS related, kind = '3' AS built, kind = '4' AS research, datediff('month', start, fin) AS lasted, datediff('month', fin, DATE '{REF}') AS ago, CASE WHEN id % 13 = 0 THEN 0 ELSE id % 20 END AS years FROM roles),
apart AS (SELECT *, CASE WHEN open THEN months - lasted ELSE abs(lasted - months) END AS off FROM dated),
ski AS (SELECT o_custkey AS id, l_partkey % 5 AS name, CASE l_returnflag WHEN 'A' THEN 0.8::DOUBLE WHEN 'N' THEN 1::DOUBLE ELSE 0.4::DOUBLE END AS w, l_returnflag IN ('A', 'N') AS claimed, (l_suppkey % 3) * 25 AS used, l_quantity::INT AS praised FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1),
skill AS (SELECT id, bool_or(name = 0) AS ground, bool_or(name = 4) AS gauging, count(*) FILTER (name IN (0, 1, 4)) AS core, sum(CASE WHEN name IN (0, 1, 4) THEN w * (0.4::DOUBLE + 0.4::DOUBLE * ln(1 + least(used, 120)) / ln(121::DOUBLE) + 0.2::DOUBLE * ln(1 + least(praised, 100)) / ln(101::DOUBLE)) ELSE 0 END) AS trust,
  count(*) FILTER (claimed AND used <= 1) AS inflated, count(*) FILTER (claimed AND id % 3 <> 0 AND name IN (0, 2)) AS tested, sum(CASE WHEN claimed AND id % 3 <> 0 AND name IN (0, 2) THEN greatest(0::DOUBLE, w - (CASE name WHEN 0 THEN id % 101 ELSE id * 7 % 101 END) / 100.0::DOUBLE) ELSE 0 END) AS over FROM ski GROUP BY id),
seen AS (SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id),
person AS (SELECT id, any_value(years)::DOUBLE AS years, count(*)::DOUBLE AS n, sum(months)::DOUBLE AS months, sum(CASE WHEN related THEN months ELSE 0 END) / 12.0::DOUBLE AS applied, bool_or(related) AS related, bool_or(built) AS built,
  count(*) FILTER (research) AS research, sum(CASE WHEN services THEN months ELSE 0 END)::DOUBLE AS services, bool_or(NOT services) AS product, min(CASE WHEN related AND ago >= 0 THEN ago END) AS since, coalesce(bool_or(related AND ago <= 18), false) AS recent,
  {", ".join(f"bool_or({c}) AS said{i}" for i, (c, _) in enumerate(_SAID))},
  count(*) FILTER (lasted >= 0 AND off > 9) + count(*) FILTER (years > 0 AND months > 12 * years + 6) AS hard, count(*) FILTER (lasted >= 0 AND off <= 9 AND off > 5) AS soft, min(start) AS first, datediff('month', min(start), max(fin)) AS span FROM apart GROUP BY id),
learnt AS (SELECT person.*, coalesce(ground, false) AS ground, coalesce(gauging, false) AS gauging, coalesce(core, 0) AS core, coalesce(trust, 0) AS trust, coalesce(inflated, 0) AS inflated, coalesce(tested, 0) AS tested, coalesce(over, 0) AS over, seen.n AS visits,
  CASE WHEN person.id % 3 = 0 THEN 1990 + person.id % 12 END AS a, CASE WHEN person.id % 5 = 0 THEN 2001 END AS b FROM person LEFT JOIN skill USING (id) LEFT JOIN seen USING (id)),
taught AS (SELECT *, coalesce(2001 - least(a, b) + 1 >= years, false) AS supported, coalesce(years >= 5 AND greatest(a, b) >= 2000 AND greatest(a, b) - year(first) > 4, false) AS graduate, id % 4 = 1 AS off_target, id % 4 IN (1, 2) AS manager,
  CASE id % 4 WHEN 0 THEN 1::DOUBLE WHEN 1 THEN 0::DOUBLE ELSE 0.4::DOUBLE END AS role_now, CASE WHEN months > 0 THEN services / months ELSE 0 END AS share, built OR said10 AS operational, said0 AS archive,
  (said3 OR gauging)::INT + said4::INT + said5::INT + related::INT AS language, said6::INT + said7::INT AS vision, CASE WHEN visits IS NOT NULL THEN visits * 37 % 420 END AS days,
  CASE id % 5 WHEN 0 THEN 1::DOUBLE WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.65::DOUBLE ELSE CASE WHEN id % 3 = 0 THEN 0.65::DOUBLE ELSE 0.3::DOUBLE END END AS place FROM learnt),
judged AS (SELECT *, hard + (span / 12.0::DOUBLE + 1.5 < years AND NOT supported)::INT + graduate::INT AS n_hard,
  0.3::DOUBLE * soft + 0.3::DOUBLE * (span / 12.0::DOUBLE + 1.5 >= years AND span / 12.0::DOUBLE + 0.75 < years AND NOT supported)::INT + 0.3::DOUBLE * (years > 0 AND months > 1.6::DOUBLE * span + 12)::INT + 0.3::DOUBLE * (inflated >= 5)::INT AS n_soft FROM taught)"""


def _records(spark, d):
    """JSON text of nested records: orders are roles, first lines of orders are skills, events are signals."""
    k, kind = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    start = F.to_date("o_orderdate")
    said = [F.when(F.expr(c.replace("k %", "o_orderkey %")), F.lit(word)) for c, word in _SAID]
    role = F.struct(
        F.when(kind == "1", "Flood Modeller").when(kind == "2", "Clerk").otherwise("Analyst").alias("title"),
        F.concat_ws(", ", F.when(kind == "3", "flood routing, operational").when(kind == "4", "dissertation").otherwise("ledger"), *said).alias("description"),
        F.when((k % 3 == 0) | (F.col("o_custkey") % 9 == 0), "Temp Agency Ltd").otherwise("Acme").alias("company"),
        F.when(k % 5 == 0, "staff leasing").otherwise("retail").alias("industry"),
        start.cast("string").alias("start_date"),
        F.when(k % 4 != 0, F.date_add(start, (k % 900).cast("int")).cast("string")).alias("end_date"),
        (k % 40).cast("string").alias("duration_months"),
    )
    orders = read(spark, d, "orders")
    roles = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(role)).alias("career_history"))  # some dozen a customer
    skill = F.struct(
        F.element_at(F.array(*map(F.lit, _SKILLS)), (F.col("l_partkey") % 5 + 1).cast("int")).alias("name"),
        F.when(F.col("l_returnflag") == "A", "advanced").when(F.col("l_returnflag") == "N", "expert").otherwise("unrated").alias("proficiency"),
        F.col("l_quantity").cast("int").cast("string").alias("endorsements"),
        ((F.col("l_suppkey") % 3) * 25).cast("string").alias("duration_months"),
    )
    skills = read(spark, d, "lineitem").where("l_linenumber = 1").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(skill)).alias("skills"))
    seen = read(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    i = F.col("id")
    text = lambda c: c.cast("string")
    flag = lambda m: (i % m == 0).cast("string")
    one_of = lambda values: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    years = F.when(i % 13 != 0, text(i % 20))
    profile = F.struct(
        F.concat(F.when(i % 7 == 0, "Senior ").otherwise(""), one_of(("Hydrologist", "Florist Superintendent", "Superintendent", "Clerk"))).alias("current_title"),
        F.when(i % 6 == 0, "Contract Bureau AG").otherwise("Acme").alias("current_company"),
        F.lit("staff leasing").alias("current_industry"),
        years.alias("years_of_experience"),
        F.when(i % 5 == 0, "early warning").otherwise("none").alias("headline"),
        F.concat_ws(" and ", F.when(i % 3 == 0, "peer review"), F.when(i % 4 == 0, "borehole")).alias("summary"),
        one_of(("Lisbon", "Turin", "Ghent", "Oslo", "Bergen")).alias("location"),
        F.when(i % 3 == 0, "Portugal").otherwise("Norway").alias("country"),
    )
    ends = F.filter(F.array(F.when(i % 3 == 0, 1990 + i % 12), F.when(i % 5 == 0, F.lit(2001))), lambda y: y.isNotNull())
    education = F.transform(ends, lambda y: F.struct(text(y).alias("end_year")))
    signals = F.struct(
        F.when(F.col("n").isNotNull(), text(F.date_sub(F.to_date(F.lit(REF)), (F.col("n") * 37 % 420).cast("int")))).alias("last_active_date"),
        text(i % 11 / 10).alias("recruiter_response_rate"), text(i % 2).alias("applications_submitted_30d"), text(i % 200).alias("avg_response_time_hours"), text(i % 12 / 10).alias("interview_completion_rate"),
        F.when(i % 3 == 0, "-1").otherwise(text(i % 7 / 6)).alias("offer_acceptance_rate"), F.when(i % 5 == 0, "-1").otherwise(text(i % 120)).alias("github_activity_score"),
        text(i % 20).alias("saved_by_recruiters_30d"), text(i % 90).alias("search_appearance_30d"), text(i % 120).alias("profile_completeness_score"), text(i % 200).alias("notice_period_days"),
        flag(2).alias("open_to_work_flag"), flag(2).alias("verified_email"), flag(3).alias("verified_phone"), flag(5).alias("linkedin_connected"), flag(4).alias("willing_to_relocate"),
        one_of(("hybrid", "Onsite", "flexible", "remote", "any")).alias("preferred_work_mode"),
        F.when(i % 3 != 0, F.create_map(F.lit("groundwater"), text(i % 101), F.lit("excel"), text(i * 7 % 101))).alias("skill_assessment_scores"),
    )
    rows = roles.join(skills, "id", "left").join(seen, "id", "left")
    return rows.select("id", F.to_json(F.struct(text(i).alias("candidate_id"), profile.alias("profile"), "career_history", "skills", education.alias("education"), signals.alias("signals"))).alias("record"))


def _people(spark, d, years_given=None):
    """The records read as such: lenient leaves, declared types."""
    return typed(_records(spark, d).select(F.from_json("record", raw_schema()).alias("r")).select("r.*"), years_given=years_given)


_SCORE = lambda x: f"least(1::DOUBLE, greatest(0::DOUBLE, {x}))"
_FEATURES = {
    "role_target_current": "role_now", "role_target_best": "greatest(role_now, related::INT::DOUBLE)", "relevant_history_flag": "related::INT::DOUBLE", "ever_built_relevant_flag": "built::INT::DOUBLE",
    "is_offtarget_current": "off_target::INT::DOUBLE", "is_manager_current": "manager::INT::DOUBLE", "title_seniority": "CASE WHEN id % 7 = 0 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END", "yoe": "years",
    "experience_fit": "least(1::DOUBLE, 0.15::DOUBLE + 0.85::DOUBLE * exp(-pow(years - 7, 2) / 18.0::DOUBLE))", "applied_ml_years": "applied",
    "applied_ml_fraction": "CASE WHEN years > 0 THEN least(1::DOUBLE, applied / years) ELSE 0 END", "n_roles": "n", "avg_tenure_months": "months / n",
    "years_since_last_relevant": "coalesce(since / 12.0::DOUBLE, 99::DOUBLE)", "tenure_chaser_flag": "(n >= 4 AND months / n < 18)::INT::DOUBLE",
    "core_skill_score": _SCORE("trust / 4"), "core_skill_hits": "core::DOUBLE", "assessment_alignment": f"CASE WHEN tested > 0 THEN {_SCORE('1 - over / tested')} ELSE 1::DOUBLE END", "skill_claim_inflation": "inflated::DOUBLE",
    "vector_db_signal": "said0::INT::DOUBLE", "embedding_retrieval_signal": "said1::INT::DOUBLE", "eval_framework_signal": "said2::INT::DOUBLE", "nlp_ir_depth": _SCORE("language / 6.0::DOUBLE"),
    "cv_speech_robotics_dominance": "vision::DOUBLE / greatest(1, language + vision)", "cv_dominant_flag": "(vision >= 2 AND language <= 1)::INT::DOUBLE", "langchain_only_recent_flag": "(said8 AND NOT said9 AND NOT said1)::INT::DOUBLE",
    "production_signal": "operational::INT::DOUBLE", "scale_signal": "said11::INT::DOUBLE",
    "services_fraction": "share", "all_services_career_flag": "(share >= 0.95 AND months > 0)::INT::DOUBLE", "product_company_flag": "product::INT::DOUBLE", "current_is_services": "(id % 6 = 0)::INT::DOUBLE",
    "location_tier_score": "CASE WHEN place < 0.85 AND id % 4 = 0 THEN least(0.85::DOUBLE, place + 0.15::DOUBLE) ELSE place END", "in_india_flag": "(id % 3 = 0)::INT::DOUBLE", "willing_to_relocate_flag": "(id % 4 = 0)::INT::DOUBLE",
    "work_mode_fit": "CASE id % 5 WHEN 0 THEN 1::DOUBLE WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN 0.95::DOUBLE WHEN 3 THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END",
    "days_since_active": "coalesce(days, -1)::DOUBLE", "recency_score": "CASE WHEN days IS NULL THEN 0.5::DOUBLE WHEN days <= 30 THEN 1::DOUBLE WHEN days >= 365 THEN 0.35::DOUBLE ELSE 1 - 0.65::DOUBLE * (days - 30) / 335.0::DOUBLE END",
    "response_rate_score": f"CASE WHEN id % 11 = 0 AND id % 2 = 0 THEN 0.5::DOUBLE ELSE {_SCORE('0.05::DOUBLE + id % 11 / 10.0::DOUBLE')} END", "response_speed_score": f"CASE WHEN id % 200 = 0 THEN 0.5::DOUBLE ELSE {_SCORE('1 - id % 200 / 168.0::DOUBLE')} END",
    "open_to_work_flag": "(id % 2 = 0)::INT::DOUBLE", "interview_completion_score": _SCORE("id % 12 / 10.0::DOUBLE"), "offer_acceptance_score": f"CASE WHEN id % 3 = 0 THEN 0.5::DOUBLE ELSE {_SCORE('id % 7 / 6.0::DOUBLE')} END",
    "github_score": f"CASE WHEN id % 5 = 0 THEN 0.5::DOUBLE ELSE {_SCORE('id % 120 / 100.0::DOUBLE')} END", "recruiter_demand_score": _SCORE("(id % 20 + 0.2::DOUBLE * (id % 90)) / 30"), "profile_completeness_score": _SCORE("id % 120 / 100.0::DOUBLE"),
    "notice_score": _SCORE("1 - greatest(0, id % 200 - 30) / 150.0::DOUBLE"), "verification_score": "((id % 2 = 0)::INT + (id % 3 = 0)::INT + (id % 5 = 0)::INT) / 3.0::DOUBLE",
    "consistency_score": "least(1::DOUBLE, greatest(0::DOUBLE, 1 - least(1::DOUBLE, 0.5::DOUBLE * n_hard + n_soft)))", "honeypot_flag": "(n_hard >= 1)::INT::DOUBLE", "n_hard_contradictions": "n_hard::DOUBLE",
    "pure_research_flag": "(research / n >= 0.6 AND NOT operational)::INT::DOUBLE", "no_recent_code_flag": "(manager AND NOT recent)::INT::DOUBLE",
    "must_have_overlap": "must / 5.0::DOUBLE", "must_have_count": "must::DOUBLE",
}
_MUST = "(SELECT *, built::INT + (said10 OR gauging)::INT + (ground OR id % 4 = 0)::INT + (id % 5 = 0)::INT + (id % 3 = 0)::INT AS must FROM judged)"


@query(f"WITH {_ROLES} SELECT id::VARCHAR AS candidate_id, " + ", ".join(f"round({sql}, 6) AS {name}" for name, sql in _FEATURES.items()) + f" FROM {_MUST}")
def entity_features(spark, d):
    """The library's own 55 features of nested records."""
    found = FE.static_features(_people(spark, d), Policy(reference_date=REF))
    return found.select("candidate_id", *(F.round(name, 6).alias(name) for name in _FEATURES))


_TITLE = "CASE WHEN id % 7 = 0 THEN 'Senior ' ELSE '' END || CASE id % 4 WHEN 0 THEN 'Hydrologist' WHEN 1 THEN 'Florist Superintendent' WHEN 2 THEN 'Superintendent' ELSE 'Clerk' END"
_DESCRIPTION = "concat_ws(', ', CASE kind WHEN '3' THEN 'flood routing, operational' WHEN '4' THEN 'dissertation' ELSE 'ledger' END, " + ", ".join(f"CASE WHEN {c} THEN '{word}' END" for c, word in _SAID) + ")"
_WAY = lambda *texts: "CASE id % 3 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"
_MOVES = "CASE WHEN willing_to_relocate_flag > 0 THEN ', would move' ELSE '' END"
_PLACE = "CASE id % 5 WHEN 0 THEN 'Lisbon' WHEN 1 THEN 'Turin' WHEN 2 THEN 'Ghent' WHEN 3 THEN 'Oslo' ELSE 'Bergen' END"


@query(f"""WITH {_ROLES}, f AS (SELECT id, {", ".join(f"{sql} AS {name}" for name, sql in _FEATURES.items())} FROM {_MUST}),
phr AS (SELECT id, arg_min(array_to_string(w[1:14], ' '), [CASE kind WHEN '1' THEN 'Flood Modeller' WHEN '2' THEN 'Clerk' ELSE 'Analyst' END, d]) FILTER (len(w) >= 4) AS phrase FROM (SELECT *, string_split(d, ' ') AS w FROM (SELECT *, {_DESCRIPTION} AS d FROM roles)) GROUP BY id),
t AS (SELECT *, role_target_best * consistency_score AS final, {_TITLE} AS title, printf('%.1f', yoe) AS yrs, printf('%.2f', id % 11 / 10.0::DOUBLE) AS rate,
  CASE WHEN (role_target_best >= 1 OR relevant_history_flag > 0) AND applied_ml_years >= 2 THEN ', some ' || round_even(applied_ml_years, 0)::INT || ' of them applied' ELSE '' END AS told FROM f LEFT JOIN phr USING (id)),
u AS (SELECT *, CASE WHEN final >= 0.66 THEN 'strong' WHEN final >= 0.4 THEN 'good' WHEN final >= 0.22 THEN 'partial' ELSE 'weak' END AS tone, {_WAY("title || ' with ' || yrs || ' yrs' || told", "yrs || ' yrs' || told || ', currently ' || title", "title || ', ' || yrs || ' yrs of experience' || told")} AS opener,
  array_to_string(list_filter([CASE WHEN embedding_retrieval_signal > 0 THEN 'core methods' END, CASE WHEN vector_db_signal > 0 THEN 'data stores' END, CASE WHEN eval_framework_signal > 0 THEN 'evaluation' END], lambda x: x IS NOT NULL), ', ') AS deep,
  CASE WHEN location_tier_score >= 1 THEN 'based in ' || {_PLACE} || ' (preferred)' WHEN in_india_flag > 0 THEN {_PLACE} || {_MOVES} ELSE 'Norway' || CASE WHEN willing_to_relocate_flag > 0 THEN ', would move' ELSE ' (abroad)' END END AS place,
  CASE WHEN recency_score >= 0.8 AND response_rate_score >= 0.55 THEN 'answers (' || rate || '), active of late' WHEN recency_score < 0.45 OR response_rate_score < 0.2 THEN 'hard to reach (answers ' || rate || ', away for ' || days_since_active::INT || ' days)' END AS engaged,
  list_filter([CASE WHEN is_offtarget_current > 0 AND relevant_history_flag = 0 THEN 'current role is off target' END, CASE WHEN services_fraction >= 0.9 THEN 'services-only career' END, CASE WHEN honeypot_flag > 0 THEN 'the record contradicts itself' END,
    CASE WHEN cv_dominant_flag > 0 THEN 'main field is another one' END, CASE WHEN langchain_only_recent_flag > 0 THEN 'tools only, little below them' END, CASE WHEN id % 200 > 60 THEN id % 200 || ' days of notice' END], lambda x: x IS NOT NULL)[1:2] AS concerns FROM t),
v AS (SELECT *, CASE WHEN (ever_built_relevant_flag > 0 OR production_signal > 0) AND phrase IS NOT NULL THEN {_WAY("tone || ' record'", "'has built'", "tone || ' practice'")} || ': "' || phrase || '"' END AS quote,
  CASE WHEN deep <> '' THEN {_WAY("deep || ' in the record'", "'shows ' || deep", "'record covers ' || deep")} END AS depth, CASE WHEN len(concerns) > 0 THEN 'concerns: ' || array_to_string(concerns, ', ') WHEN final < 0.22 THEN 'near the cut' END AS concern FROM u),
x AS (SELECT id, concat_ws('; ', opener, quote) || '.' AS first, CASE WHEN id % 2 = 1 THEN concat_ws('; ', depth, engaged, place, concern) ELSE concat_ws('; ', depth, place, engaged, concern) END AS tail FROM v)
SELECT id::VARCHAR AS candidate_id, upper(first[1]) || first[2:] || CASE WHEN tail <> '' THEN ' ' || upper(tail[1]) || tail[2:] || '.' ELSE '' END AS reasoning FROM x""")
def reasons(spark, d):
    """The explanation of every record, by the library's own features."""
    people = _people(spark, d)
    found = FE.static_features(people, Policy(reference_date=REF)).withColumn("final", F.col("role_target_best") * F.col("consistency_score"))
    rows = found.join(explain.facts(people), "candidate_id")
    return rows.select("candidate_id", explain.reason(set(rows.columns)).alias("reasoning"))


@query(f"""WITH {_ROLES}, wrong AS (SELECT id, count(*) FILTER (abs(lasted - months) > 9) + count(*) FILTER (id % 13 <> 0 AND months > 12 * years + 6) AS n FROM apart GROUP BY id)
SELECT id::VARCHAR AS candidate_id, (wrong.n + (id % 13 <> 0 AND span / 12.0::DOUBLE + 0.5 < years - 2)::INT + (inflated >= 4)::INT + (id % 13 <> 0 AND coalesce(years >= 5 AND greatest(a, b) - year(first) > 4 AND greatest(a, b) >= 1999, false))::INT)::INT AS reasons FROM judged JOIN wrong USING (id)""")
def profile_contradictions(spark, d):
    """Contradictions by the rules of the data profile; missing years are no contradiction."""
    policy = Policy(reference_date=REF)
    people = _people(spark, d, "given")
    return FE.enrich(people, policy).select("candidate_id", audit.timeline_variant(policy, F.col("given")).alias("reasons"))


@query("""SELECT c_custkey, CASE WHEN base < 0.85 AND moves THEN least(0.85::DOUBLE, base + 0.15::DOUBLE) ELSE base END AS tier FROM (
  SELECT c_custkey, c_acctbal > 0 AS moves, CASE WHEN regexp_matches(lower(n_name), '1') THEN 1::DOUBLE WHEN regexp_matches(lower(n_name), '2') THEN 0.85::DOUBLE WHEN r_regionkey = 0 THEN 0.65::DOUBLE ELSE 0.3::DOUBLE END AS base
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""")
def location_tier(spark, d):
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.lower("n_name")
    base = F.when(name.contains("1"), 1.0).when(name.contains("2"), 0.85).when(F.col("r_regionkey") == 0, 0.65).otherwise(0.3)
    return rows.select("c_custkey", F.when((base < 0.85) & (F.col("c_acctbal") > 0), F.least(F.lit(0.85), base + 0.15)).otherwise(base).alias("tier"))


_SCORED = f"""WITH {_HISTORY}, {_BEHAVIOUR},
f AS (SELECT bf.id, CASE WHEN coalesce(months, 0) > 0 THEN applied / months ELSE 0 END AS fraction, coalesce(any_f, 0) AS built, coalesce(applied > 0, false) AS history, c_acctbal AS dense_margin, c_mktsegment = 'BUILDING' AS off_target,
  bf.id % 17 = 0 AS flagged, recency, offer, interview FROM bf JOIN customer ON c_custkey = bf.id LEFT JOIN h ON h.id = bf.id),
r AS (SELECT *, (dense_margin - min(dense_margin) OVER ()) / (max(dense_margin) OVER () - min(dense_margin) OVER ()) AS mm FROM f),
rb AS (SELECT *, 0.3::DOUBLE * least(1, 0.7::DOUBLE * history::INT + 0.3::DOUBLE * built) + 0.15::DOUBLE * (0.7::DOUBLE * mm) + 0.12::DOUBLE * (0.4::DOUBLE * fraction) + 0.1::DOUBLE * (0.2::DOUBLE * built) + 0.1::DOUBLE AS rubric FROM r),
s AS (SELECT id, rubric, least(1.05::DOUBLE, greatest(0.75::DOUBLE, 0.75::DOUBLE + 0.3::DOUBLE * (0.45::DOUBLE * recency + 0.05::DOUBLE + 0.08::DOUBLE * interview + 0.07::DOUBLE * offer))) AS availability,
  CASE WHEN off_target AND built > 0 THEN 0.7::DOUBLE WHEN off_target AND history THEN 0.5::DOUBLE WHEN off_target THEN 0.15::DOUBLE ELSE 1::DOUBLE END AS gate, CASE WHEN flagged THEN 0.03::DOUBLE ELSE 1::DOUBLE END AS consistent FROM rb),
z AS (SELECT id, rubric, availability, gate, consistent, least(1, rubric) * availability * 0.7::DOUBLE * gate * consistent AS final FROM s)
"""


def _scored(spark, d):
    folds = history_folds(spark, d).select("id", F.col("share").alias("applied_ml_fraction"), F.col("any_f").alias("ever_built_relevant_flag"), (F.col("applied_years") > 0).cast("double").alias("relevant_history_flag"))
    base = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("dense_margin"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("is_offtarget_current"))
    rows = base.join(_behaviour(spark, d), "id").join(folds, "id", "left").fillna(0.0)
    rows = rows.select(
        "id", "dense_margin", "is_offtarget_current", "applied_ml_fraction", "ever_built_relevant_flag", "relevant_history_flag", F.col("relevant_history_flag").alias("role_target_best"),
        (F.col("id") % 17 == 0).cast("double").alias("honeypot_flag"), F.col("recency").alias("recency_score"), F.col("offer").alias("offer_acceptance_score"), F.col("interview").alias("interview_completion_score"), F.col("id").cast("string").alias("candidate_id"),
    )
    return scoring.score(rows)


@query(_SCORED + "SELECT id, round(rubric, 6) AS rubric, round(availability, 6) AS availability, gate, consistent, round(final, 6) AS final FROM z")
def final_score(spark, d):
    return _scored(spark, d).select("id", F.round("rubric", 6).alias("rubric"), F.round("availability", 6).alias("availability"), F.col("offtarget_gate").alias("gate"), F.col("honeypot_gate").alias("consistent"), F.round("final", 6).alias("final"))


@query(_SCORED + "SELECT id::VARCHAR AS candidate_id, round(final, 6) AS final, row_number() OVER (ORDER BY round(final, 6) DESC, id::VARCHAR)::INT AS rank FROM z ORDER BY round(final, 6) DESC, id::VARCHAR LIMIT 100")
def rank_top100(spark, d):
    """Rounded before ranking, so ties do not hang on the last bits of a float."""
    scored = _scored(spark, d).withColumn("final", F.round("final", 6))
    return scoring.rank_top(scored, 100).select("candidate_id", "final", "rank")


@query("SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal) DESC, c_custkey)::INT AS rank FROM customer) WHERE rank <= 3")
def topk_per_group(spark, d):
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.abs("c_acctbal").desc(), "c_custkey"))
    return read(spark, d, "customer").select("c_nationkey", "c_custkey", rank.alias("rank")).where("rank <= 3")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def anti_join(spark, d):
    return remaining(read(spark, d, "customer").select("c_custkey"), read(spark, d, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = c_custkey")
def left_default(spark, d):
    seen = read(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read(spark, d, "customer").join(seen, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey, c_acctbal FROM customer JOIN (SELECT DISTINCT user_id FROM events) ON user_id = c_custkey")
def key_intersection(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "events").select(F.col("user_id").alias("c_custkey")).distinct(), "c_custkey").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, 'cached' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'live' FROM customer WHERE c_custkey % 2 <> 0")
def union_cached_live(spark, d):
    c = read(spark, d, "customer").select("c_custkey")
    cached = c.where("c_custkey % 2 = 0").withColumn("origin", F.lit("cached"))
    return cached.unionByName(remaining(c, cached, "c_custkey").withColumn("origin", F.lit("live")))


@query("SELECT event_type, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) FILTER (value > 50) / count(*), 1) AS pct_high, round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90, stddev_pop(value) IS NOT NULL AS has_sd FROM events GROUP BY event_type")
def event_profile(spark, d):
    events = read(spark, d, "events")
    counted = events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("value") > 50) / F.count("*"), 1).alias("pct_high"), F.stddev_pop("value").isNotNull().alias("has_sd"))
    ranked = E.percentiles(events, "value", "event_type", {"med": 0.5, "p90": 0.9})
    return counted.join(ranked, "event_type").select("event_type", "n", "pct_high", F.round("med", 6).alias("med"), F.round("p90", 6).alias("p90"), "has_sd")


@query("SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def most_common(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("SELECT event_type, value AS pct FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = round_even(0.9::DOUBLE * (n - 1), 0)::INT + 1")
def nearest_rank(spark, d):
    return E.nearest_rank(read(spark, d, "events"), "value", 0.9, "event_type")


@query("SELECT l_returnflag, least(floor((l_discount - 0) / 0.1::DOUBLE * 40), 39)::INT AS bin, count(*)::BIGINT AS n FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1 GROUP BY ALL")
def histogram(spark, d):
    return E.histogram(read(spark, d, "lineitem"), "l_discount", "l_returnflag", 40, 0.0, 0.1)


@query("""SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':42'), c_custkey) AS n FROM customer) WHERE (c_mktsegment = 'BUILDING' AND n <= 30) OR (c_mktsegment = 'MACHINERY' AND n <= 22)""")
def stratified_sample(spark, d):
    return E.stratified(read(spark, d, "customer"), "c_mktsegment", {"BUILDING": 30, "MACHINERY": 22}, "c_custkey").select("c_custkey", "c_mktsegment")


def _quota_sql(whole: str, strata: tuple[tuple[str, int], ...], total: int) -> str:
    """Overlapping strata: each takes its first rows by hash; the union is filled up and cut by hash."""
    taken = " OR ".join([f"coalesce({whole}, false)", *(f"({c} AND n{i} <= {k})" for i, (c, k) in enumerate(strata))])
    numbers = ", ".join(f"row_number() OVER (PARTITION BY ({c}) ORDER BY md5(c_custkey || ':42'), c_custkey) AS n{i}" for i, (c, _) in enumerate(strata))
    return f"""SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY NOT taken, md5(c_custkey || ':42'), c_custkey) AS n FROM (
  SELECT c_custkey, ({taken}) AS taken FROM (SELECT *, {numbers} FROM customer))) WHERE n <= {total}"""


_STRATA = (("c_nationkey < 9", 15), ("c_acctbal > 5000", 11), ("c_mktsegment = 'BUILDING'", 12))


@query(_quota_sql("c_nationkey < 2 AND c_acctbal < 0", _STRATA, 50))
def quota_sample(spark, d):
    return E.sample_with_quotas(read(spark, d, "customer"), F.expr("c_nationkey < 2 AND c_acctbal < 0"), [(F.expr(_STRATA[0][0]), 0.30), (F.expr(_STRATA[1][0]), 0.22), (F.expr(_STRATA[2][0]), 0.25)], 50, "c_custkey").select("c_custkey")


@query(_quota_sql("c_nationkey < 5", _STRATA[1:], 20).replace("<= 11", "<= 4").replace("<= 12", "<= 5"))
def quota_overfull(spark, d):
    """A stratum that is taken whole and larger than the sample: it is cut."""
    return E.sample_with_quotas(read(spark, d, "customer"), F.expr("c_nationkey < 5"), [(F.expr(_STRATA[1][0]), 0.22), (F.expr(_STRATA[2][0]), 0.25)], 20, "c_custkey").select("c_custkey")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) <= floor((SELECT count(*) FROM labels) * 0.2::DOUBLE) AS validation FROM labels")
def hash_split(spark, d):
    return E.split(read(spark, d, "labels").select("doc_id"), "doc_id")


_TIER = "CASE WHEN quality = 1 AND toxic = 0 THEN 3 WHEN quality = 1 THEN 2 ELSE 0 END + (doc_id % 5 = 0)::INT"
_METRIC_SQL = """, hits AS (SELECT *, (tier >= 3)::INT AS hit, row_number() OVER (PARTITION BY k ORDER BY score DESC, id) AS pos, row_number() OVER (PARTITION BY k ORDER BY tier DESC, id) AS ideal FROM long),
seen AS (SELECT *, sum(hit) OVER (PARTITION BY k ORDER BY pos) AS seen FROM hits),
met AS (SELECT k, sum(CASE WHEN pos <= 10 THEN (pow(2, tier) - 1) / log2(pos + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= 10 THEN (pow(2, tier) - 1) / log2(ideal + 1) ELSE 0 END), 0) AS ndcg10,
  sum(CASE WHEN pos <= 50 THEN (pow(2, tier) - 1) / log2(pos + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= 50 THEN (pow(2, tier) - 1) / log2(ideal + 1) ELSE 0 END), 0) AS ndcg50,
  coalesce(sum(hit * seen / pos::DOUBLE) / nullif(sum(hit), 0), 0) AS map, sum(CASE WHEN pos <= 5 THEN hit ELSE 0 END) / 5.0::DOUBLE AS p5, sum(CASE WHEN pos <= 10 THEN hit ELSE 0 END) / 10.0::DOUBLE AS p10 FROM seen GROUP BY k),
final AS (SELECT k, coalesce(ndcg10, 0) AS ndcg10, coalesce(ndcg50, 0) AS ndcg50, map, p5, p10 FROM met)
"""
_LABELLED = f"lab AS (SELECT labels.doc_id AS id, {_TIER} AS tier, round(bm25, 6) AS bm25, n_chars::DOUBLE AS n_chars FROM labels JOIN bm USING (doc_id) JOIN documents USING (doc_id))"


def _labelled(spark, d):
    tier = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 3).when(F.col("quality") == 1, 2).otherwise(0) + (F.col("doc_id") % 5 == 0).cast("int")
    docs = read(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    rows = read(spark, d, "labels").join(bm25_all(spark, d), "doc_id").join(docs, "doc_id")
    return rows.select(F.col("doc_id").alias("id"), tier.alias("tier"), "bm25", "n_chars")


@query(_BM25 + ", " + _LABELLED + ", long AS (SELECT 'bm25' AS k, id, tier, bm25 AS score FROM lab UNION ALL SELECT 'length', id, tier, n_chars FROM lab)" + _METRIC_SQL + "SELECT k AS variant, round(ndcg10, 6) AS ndcg10, round(ndcg50, 6) AS ndcg50, round(map, 6) AS map, round(p5, 6) AS p5, round(p10, 6) AS p10, round(0.5 * ndcg10 + 0.3 * ndcg50 + 0.15 * map + 0.05 * p10, 6) AS composite FROM final")
def ablation(spark, d):
    out = E.metrics(E.variants(_labelled(spark, d), {"bm25": "bm25", "length": "n_chars"}), "variant", "score")
    return out.select("variant", *(F.round(c, 6).alias(c) for c in ("ndcg10", "ndcg50", "map", "p5", "p10", "composite")))


_SWEEP = _BM25 + ", " + _LABELLED + ", long AS (SELECT p::DOUBLE AS k, id, tier, p::DOUBLE * bm25 + (1 - p::DOUBLE) * n_chars / 1000 AS score FROM lab, (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) g(p))" + _METRIC_SQL


def _swept(spark, d):
    return E.sweep(_labelled(spark, d), [0.0, 0.25, 0.5, 0.75, 1.0], F.col("p") * F.col("bm25") + (1 - F.col("p")) * F.col("n_chars") / 1000)


@query(_SWEEP + "SELECT k AS p, round(0.5 * ndcg10 + 0.3 * ndcg50 + 0.15 * map + 0.05 * p10, 6) AS composite FROM final")
def parameter_sweep(spark, d):
    return _swept(spark, d).select("p", F.round("composite", 6).alias("composite"))


@query(_SWEEP + "SELECT k AS best_p, round(0.5 * ndcg10 + 0.3 * ndcg50 + 0.15 * map + 0.05 * p10, 6) AS best_value FROM final ORDER BY best_value DESC, k LIMIT 1")
def best_parameter(spark, d):
    return E.best_parameter(parameter_sweep(spark, d))


@query(_BM25 + ", " + _LABELLED + ", n AS (SELECT count(*) AS n FROM lab), rows_ AS (SELECT row_number() OVER (ORDER BY id) - 1 AS idx, tier, bm25 FROM lab), long AS (SELECT b AS k, i AS id, tier, bm25 AS score FROM n, unnest(range(0, 1000)) x(b), unnest(range(0, n)) y(i) JOIN rows_ ON idx = ('0x' || substr(md5(b || ':' || i || ':42'), 1, 15))::BIGINT % n)" + _METRIC_SQL + ", c AS (SELECT 0.5 * ndcg10 + 0.3 * ndcg50 + 0.15 * map + 0.05 * p10 AS c FROM final) SELECT round(avg(c), 5) AS mean, round(stddev_pop(c), 5) AS std, round(quantile_cont(c, 0.025), 5) AS low, round(quantile_cont(c, 0.975), 5) AS high FROM c")
def bootstrap_ci(spark, d):
    out = E.bootstrap(_labelled(spark, d), "bm25", 1000)
    return out.select(*(F.round(c, 5).alias(c) for c in ("mean", "std", "low", "high")))


@query(_BM25 + ", " + _LABELLED + ", n AS (SELECT count(*) AS n FROM lab), rows_ AS (SELECT row_number() OVER (ORDER BY id) - 1 AS idx, tier, bm25, n_chars FROM lab), drawn AS (SELECT b, i AS id, tier, bm25, n_chars FROM n, unnest(range(0, 200)) x(b), unnest(range(0, n)) y(i) JOIN rows_ ON idx = ('0x' || substr(md5(b || ':' || i || ':42'), 1, 15))::BIGINT % n), long AS (SELECT 'bm25:' || b AS k, id, tier, bm25 AS score FROM drawn UNION ALL SELECT 'length:' || b, id, tier, n_chars FROM drawn)" + _METRIC_SQL + ", c AS (SELECT split_part(k, ':', 1) AS variant, 0.5 * ndcg10 + 0.3 * ndcg50 + 0.15 * map + 0.05 * p10 AS c FROM final) SELECT variant, round(avg(c), 5) AS mean, round(stddev_pop(c), 5) AS std, round(quantile_cont(c, 0.025), 5) AS low, round(quantile_cont(c, 0.975), 5) AS high FROM c GROUP BY variant")
def bootstrap_variants(spark, d):
    """Intervals of two variants over the same resamples."""
    out = E.bootstrap_variants(_labelled(spark, d), {"bm25": "bm25", "length": "n_chars"}, 200)
    return out.select("variant", *(F.round(c, 5).alias(c) for c in ("mean", "std", "low", "high")))


@query(_SCORED + "SELECT count(*) FILTER (gate < 1)::BIGINT AS off_target, count(*) FILTER (consistent < 1)::BIGINT AS flagged FROM (SELECT * FROM z ORDER BY round(final, 6) DESC, id::VARCHAR LIMIT 100)")
def health_counts(spark, d):
    scored = _scored(spark, d).withColumn("final", F.round("final", 6))
    return E.health(scored, {"off_target": F.col("offtarget_gate") < 1, "flagged": F.col("honeypot_gate") < 1}, 100, F.desc("final"), F.col("candidate_id"))


_VARIANTS = {"keyword": "offer_acceptance_score", "dense": "dense_margin", "rubric": "rubric", "gated": "gated", "full": "final"}


@query(_SCORED + ", v AS (SELECT z.*, f.offer, f.dense_margin FROM z JOIN f USING (id)), long AS (SELECT k, id, id % 5 AS tier, score FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS k, id, round({sql}, 6) AS score FROM v" for k, sql in (("keyword", "offer"), ("dense", "dense_margin"), ("rubric", "rubric"), ("gated", "rubric * gate * consistent"), ("full", "final"))) + "))" + _METRIC_SQL.replace("final AS", "measured AS") + ", top AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY score DESC, id) AS n FROM long), hl AS (SELECT k, count(*) FILTER (gate < 1) AS off_target, count(*) FILTER (consistent < 1) AS flagged FROM top JOIN z USING (id) WHERE n <= 100 GROUP BY k) SELECT k AS variant, round(ndcg10, 4) AS ndcg10, round(map, 4) AS map, round(0.5 * ndcg10 + 0.3 * ndcg50 + 0.15 * map + 0.05 * p10, 4) AS composite, off_target, flagged FROM measured JOIN hl USING (k)")
def ablation_health(spark, d):
    """Five variants of the score: their metrics beside what their 100 best rows carry."""
    scored = _scored(spark, d).withColumn("gated", F.col("rubric") * F.col("offtarget_gate") * F.col("honeypot_gate"))
    rows = scored.select("id", (F.col("id") % 5).alias("tier"), "offtarget_gate", "honeypot_gate", *(F.round(c, 6).alias(c) for c in _VARIANTS.values()))
    out = E.ablation_table(rows, _VARIANTS, {"off_target": F.col("offtarget_gate") < 1, "flagged": F.col("honeypot_gate") < 1}, 100)
    return out.select("variant", *(F.round(c, 4).alias(c) for c in ("ndcg10", "map", "composite")), "off_target", "flagged")


_MOVED = {
    "blend": (21, 0, 20.0, "least(1, p * mm + (1 - p) * least(1, rubric)) * availability * gate * consistent"),
    "offtarget_gate": (21, 0, 40.0, "least(1, rubric) * availability * CASE WHEN off_target AND built > 0 THEN 0.7::DOUBLE WHEN off_target AND history THEN greatest(p, 0.5::DOUBLE) WHEN off_target THEN p ELSE 1::DOUBLE END * consistent"),
    "consistency_gate": (21, 0, 100.0, "least(1, rubric) * availability * gate * CASE WHEN flagged THEN p ELSE 1::DOUBLE END"),
    "availability_floor": (21, 6, 20.0, "least(1, rubric) * least(1.05::DOUBLE, greatest(p, p + (1.05::DOUBLE - p) * (0.45::DOUBLE * recency + 0.05::DOUBLE + 0.08::DOUBLE * interview + 0.07::DOUBLE * offer))) * gate * consistent"),
}


@query(_SCORED + ", v AS (SELECT z.*, mm, recency, interview, offer, off_target, built, history, flagged FROM z JOIN rb USING (id)), long AS (SELECT name || ':' || p AS k, id, id % 5 AS tier, round(score, 9) AS score FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS name, p, id, {sql} * 0.7::DOUBLE AS score FROM (SELECT v.*, i / {d}::DOUBLE AS p FROM v, unnest(range({low}, {high})) t(i))" for name, (high, low, d, sql) in _MOVED.items()) + "))" + _METRIC_SQL.replace("final AS", "measured AS") + "SELECT split_part(k, ':', 1) AS parameter, round(split_part(k, ':', 2)::DOUBLE, 4) AS p, round(0.5 * ndcg10 + 0.3 * ndcg50 + 0.15 * map + 0.05 * p10, 6) AS composite FROM measured")
def sensitivity(spark, d):
    """Each parameter of the final score alone moved over its grid; the margin stands for a model."""
    scored = stored(_scored(spark, d).withColumn("tier", F.col("id") % 5), "scored")  # read for the range of the margin and for the points
    low, high = X.min_max_stats(scored, "dense_margin").first()
    model = scored.withColumn("model", X.min_max(F.col("dense_margin"), F.lit(low), F.lit(high)))
    return E.sensitivity(model, model="model").select("parameter", F.round("p", 4).alias("p"), F.round("composite", 6).alias("composite"))


@query("SELECT l_orderkey, l_linenumber, printf('%.0f', x) AS zero, printf('%.1f', x) AS one, printf('%.2f', x) AS two FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice / 64.0::DOUBLE ELSE l_quantity * l_discount + l_tax END AS x FROM lineitem)")
def output_rounding(spark, d):
    """Numbers as texts of zero, one and two digits, ties by their exact value."""
    x = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice") / 64.0).otherwise(F.col("l_quantity") * F.col("l_discount") + F.col("l_tax"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(X.fixed(x, k).alias(name) for k, name in enumerate(("zero", "one", "two"))))


_RANKED_100 = "SELECT id::VARCHAR AS candidate_id, row_number() OVER (ORDER BY round(final, 6) DESC, id::VARCHAR)::INT AS rank, round(final, 6) AS score FROM z ORDER BY round(final, 6) DESC, id::VARCHAR LIMIT 100"


@query(_SCORED + f"""SELECT candidate_id, rank, score, 'rank ' || rank || ', "quoted", as written' AS reasoning FROM ({_RANKED_100})""")
def ranking_file(spark, d):
    """The ranking written as CSV and read back."""
    path = work_path(spark, "ranking")
    text = F.concat(F.lit("rank "), F.col("rank").cast("string"), F.lit(', "quoted", as written'))
    write_ranking(rank_top100(spark, d).withColumn("reasoning", text), path)
    return read_ranking(spark, path)


@query("SELECT c_custkey, round(CASE WHEN c_acctbal::FLOAT::DOUBLE <= 1000 THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END + 0.05::DOUBLE, 6) AS score FROM customer")
def model_file(spark, d):
    """A model saved and loaded again; the column that rows lack counts as 0."""
    path = work_path(spark, "model")
    trees.save_model(spark, path, *trees.parse_model(MODEL))
    return read(spark, d, "customer").select("c_custkey", F.round(trees.predict_column(*trees.load_model(spark, path), missing={"c_nationkey"}), 6).alias("score"))


@query(f"WITH {_ROLES}, u AS (SELECT id::VARCHAR AS candidate_id, years, n::INT AS n_roles FROM person) SELECT 'array' AS kind, * FROM u UNION ALL SELECT 'lines', * FROM u")
def uploads(spark, d):
    """Records as JSON arrays of fifty, and as lines between broken ones: what an upload holds."""
    path = work_path(spark, "uploads")
    records = stored(_records(spark, d), "records")
    arrays = records.groupBy(F.floor(F.col("id") / 50)).agg(F.concat(F.lit("["), F.array_join(F.collect_list("record"), ", "), F.lit("]")).alias("value"))  # fifty
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/array")  # a file, not a task, for each
    records.select(F.explode(F.array(F.col("record"), F.lit(" "), F.lit("{broken"), F.lit("3"))).alias("value")).write.text(f"{path}/lines")
    of = lambda kind: read_upload(spark, f"{path}/{kind}", cap=None).select(F.lit(kind).alias("kind"), "candidate_id", F.col("profile.years_of_experience").alias("years"), F.size("career_history").alias("n_roles"))
    return of("array").unionByName(of("lines"))


@query(f"WITH {_ROLES} SELECT id::VARCHAR AS candidate_id, CASE WHEN n_hard >= 1 THEN 0 ELSE id % 5 END::INT AS tier FROM judged")
def training_tiers(spark, d):
    """Labels joined with features; records that contradict themselves train as tier 0."""
    found = FE.static_features(_people(spark, d), Policy(reference_date=REF)).select("candidate_id", "honeypot_flag")
    labels = found.select("candidate_id", (F.col("candidate_id").cast("long") % 5).cast("int").alias("tier"))
    return audit.tiers_for_training(labels, found).select("candidate_id", "tier")


@query(f"""WITH {_ROLES}, t AS (SELECT id, CASE kind WHEN '1' THEN 'Flood Modeller' WHEN '2' THEN 'Clerk' ELSE 'Analyst' END AS title, {_DESCRIPTION} AS d, CASE WHEN o.services THEN 'Temp Agency Ltd' ELSE 'Acme' END AS c, k, start FROM roles o),
c AS (SELECT id, string_agg(title || ' ' || d, ' ' ORDER BY title, d, c) AS text FROM t GROUP BY id), k AS (SELECT id, count(*) AS n, count(DISTINCT name) AS kinds FROM ski GROUP BY id)
SELECT id::VARCHAR AS candidate_id, id AS digits, length({_TITLE} || '. ' || CASE WHEN id % 5 = 0 THEN 'early warning' ELSE 'none' END || '. ' || concat_ws(' and ', CASE WHEN id % 3 = 0 THEN 'peer review' END, CASE WHEN id % 4 = 0 THEN 'borehole' END))::INT + 2 * (length(c.text)::INT + 1) AS head_and_career, coalesce(k.kinds, 0)::INT AS skill_names FROM c LEFT JOIN k USING (id)""")
def entity_texts(spark, d):
    """Lengths of the encoder's texts (title, headline, summary, the career twice) without the skills, and what else is read off a record."""
    people = _people(spark, d)
    names = F.transform("skills", lambda x: x["name"])
    skills = F.array_join(F.filter(names, lambda n: n != ""), " ")
    whole = F.length(FE.entity_text()) - F.when(F.length(skills) > 0, F.length(skills) + 1).otherwise(0)
    return people.select("candidate_id", X.python_int(F.concat(F.lit("CAND-"), F.col("candidate_id"))).alias("digits"), whole.alias("head_and_career"), F.size(X.deduped(names)).alias("skill_names"))


@query("SELECT c_custkey, length(c_name)::INT AS name_length, least(280, length(c_name) * 40)::INT AS long_length, 5 AS items, 'be strict' AS rubric FROM customer")
def judge_messages(spark, d):
    """Messages to a judge: texts and lists are cut to their caps, then built as JSON."""
    rows = read(spark, d, "customer").select("c_custkey", "c_name", F.repeat("c_name", 40).alias("long"), F.sequence(F.lit(1), F.lit(9)).alias("items"))
    sent = rows.select("c_custkey", F.from_json(labeling.message(rows, "be strict"), "system string, user string").alias("m"))
    user = F.from_json("m.user", "c_name string, long string, items array<int>")
    return sent.select("c_custkey", F.length(user["c_name"]).alias("name_length"), F.length(user["long"]).alias("long_length"), F.size(user["items"]).alias("items"), F.col("m.system").alias("rubric"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'kept' WHEN c_custkey % 3 = 1 THEN 'first' ELSE 'second' END AS client, (c_custkey % 5)::INT AS tier FROM customer")
def judged_labels(spark, d):
    """Labels by two judges: what is stored is not asked again, what the first one can't answer goes to the second."""
    path = work_path(spark, "labels")
    rows = read(spark, d, "customer").select("c_custkey")
    messages = rows.select("c_custkey", F.col("c_custkey").cast("string").alias("message"))
    answer = lambda name: F.format_string('{"tier": %d, "reasoning": "' + name + '"}', F.col("c_custkey") % 5)
    rows.where("c_custkey % 3 = 0").select("c_custkey", answer("kept").alias("reply")).write.json(path)

    def first(text: str) -> str:
        if int(text) % 3 == 2:
            return "no judgment, sorry"
        return '{"tier": %d, "reasoning": "first"}' % (int(text) % 5)

    def second(text: str) -> str:
        return '```json\n{"tier": %d, "reasoning": "second"}\n```' % (int(text) % 5)

    rates = {"per_minute": 1e9, "partitions": 4, "tokens_per_minute": 1e9}
    found = labeling.judge_all(messages, "c_custkey", [first], path, tries=1, **rates)
    judged = found.select("c_custkey", labeling.parse_judgment(F.col("reply")).alias("j")).where("j IS NOT NULL")
    again = labeling.judge_all(remaining(messages, judged, "c_custkey"), "c_custkey", [second], f"{path}-second", tries=1, **rates)
    every = judged.unionByName(again.select("c_custkey", labeling.parse_judgment(F.col("reply")).alias("j")))
    return every.select("c_custkey", F.col("j.reasoning").alias("client"), "j.tier")


@query(_SCORED + "SELECT rb.id, round(least(1::DOUBLE, greatest(0::DOUBLE, 0.6::DOUBLE * mm + 0.4::DOUBLE * least(1::DOUBLE, rubric))), 6) AS fit FROM rb")
def blended_score(spark, d):
    """Rubric and a model's score, here the margin, blended after the model's scores are brought to 0 to 1."""
    return scoring.blended(_scored(spark, d).drop("lgbm", "fit_raw"), F.col("dense_margin")).select("id", F.round("fit_raw", 6).alias("fit"))


@query("SELECT 'features' AS store, c_custkey AS key, round(c_acctbal, 2) AS value FROM customer UNION ALL SELECT 'vectors', vec_id, round(embedding[1]::DOUBLE, 6) FROM embeddings UNION ALL SELECT 'labels', doc_id, quality::DOUBLE FROM labels UNION ALL SELECT 'labels', doc_id, toxic::DOUBLE FROM labels")
def stores(spark, d):
    """Features, vectors and labels as stores: written, overwritten, appended to, read."""
    path = work_path(spark, "stores")
    features = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.round("c_acctbal", 2).alias("value"))
    embedded = read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    labels = read(spark, d, "labels")
    save(features.limit(3), f"{path}/features")
    save(features, f"{path}/features")
    save(embedded, f"{path}/vectors")
    for name in ("quality", "toxic"):
        save(labels.select(F.col("doc_id").alias("key"), F.col(name).cast("double").alias("value")), f"{path}/labels", "append")
    back = lambda name: load(spark, f"{path}/{name}")
    out = {"features": back("features"), "vectors": back("vectors").select("key", F.round(F.col("embedding")[0].cast("double"), 6).alias("value")), "labels": back("labels")}
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("store"), "key", "value") for name, df in out.items()))


@query("SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE least(4, greatest(0, conv_id % 9 - 2))::INT END AS tier FROM conversations")
def judge_json(spark, d):
    tier = (F.col("conv_id") % 9 - 2).cast("string")
    body = F.concat(F.lit('{"tier": "'), tier, F.lit('", "reasoning": "r", "key_factors": ["a"]}'))
    kind = F.col("turn") % 5
    reply = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is: "), body, F.lit(" done."))).when(kind == 3, F.concat(F.lit("\n"), body)).otherwise(F.lit("no judgment"))
    return read(spark, d, "conversations").select("conv_id", "turn", labeling.parse_judgment(reply)["tier"].alias("tier"))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def checkpoint_latest(spark, d):
    return latest(read(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", [F.col("event_id")]).select("user_id", "event_type", "value")


MODEL = """feature_names=c_acctbal c_nationkey
Tree=0
split_feature=0 1
split_gain=10 4
threshold=1000 12.5
left_child=-1 -2
right_child=1 -3
leaf_value=0.1 0.2 -0.3
leaf_count=10 20 30
internal_count=60 50
Tree=1
split_feature=1
split_gain=3
threshold=5.5
left_child=-1
right_child=-2
leaf_value=0.05 -0.05
leaf_count=25 35
internal_count=60
end of trees
"""


@query("SELECT c_custkey, round(CASE WHEN c_acctbal::FLOAT::DOUBLE <= 1000 THEN 0.1::DOUBLE WHEN c_nationkey <= 12.5 THEN 0.2::DOUBLE ELSE -0.3::DOUBLE END + CASE WHEN c_nationkey <= 5.5 THEN 0.05::DOUBLE ELSE -0.05::DOUBLE END, 6) AS score FROM customer")
def tree_predict(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.round(trees.predict_column(*trees.parse_model(MODEL)), 6).alias("score"))


@query("""WITH m AS (SELECT n_name AS feature, count(*) * 1.0::DOUBLE AS gain FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name)
SELECT feature, gain FROM m ORDER BY gain DESC, feature LIMIT 15""")
def feature_importance(spark, d):
    """Gains of splits that lie in a table: here a split for each customer above a balance, on the feature of their nation."""
    splits = read(spark, d, "customer").where("c_acctbal > 0").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return trees.importance(splits.select(F.col("n_name").alias("feature"), F.lit(1.0).alias("gain")))


_SHAP = """WITH c AS (SELECT c_custkey, c_acctbal, c_acctbal::FLOAT::DOUBLE <= 1000 AS a, c_nationkey <= 12.5 AS n, c_nationkey <= 5.5 AS m FROM customer),
v AS (SELECT *, 0.1::DOUBLE / 6 + 5 / 6.0::DOUBLE * (0.4::DOUBLE * 0.2 + 0.6::DOUBLE * -0.3) AS v0, CASE WHEN a THEN 0.1::DOUBLE ELSE 0.4::DOUBLE * 0.2 + 0.6::DOUBLE * -0.3 END AS va,
  0.1::DOUBLE / 6 + 5 / 6.0::DOUBLE * (CASE WHEN n THEN 0.2::DOUBLE ELSE -0.3::DOUBLE END) AS vn, CASE WHEN a THEN 0.1::DOUBLE WHEN n THEN 0.2::DOUBLE ELSE -0.3::DOUBLE END AS van,
  CASE WHEN m THEN 0.05::DOUBLE ELSE -0.05::DOUBLE END - (25 / 60.0::DOUBLE * 0.05 - 35 / 60.0::DOUBLE * 0.05) AS second FROM c),
p AS (SELECT c_custkey, c_acctbal, (va - v0 + van - vn) / 2 AS pa, (vn - v0 + van - va) / 2 + second AS pn FROM v),
l AS (SELECT c_custkey, c_acctbal, 'c_acctbal' AS factor, pa AS x FROM p UNION ALL SELECT c_custkey, c_acctbal, 'c_nationkey', pn FROM p)
"""
_LABELS = {"c_acctbal": "balance"}


@query(_SHAP + "SELECT c_custkey, factor, CASE factor WHEN 'c_acctbal' THEN 'balance' ELSE factor END AS label, round(x, 6) AS shap_value FROM l WHERE c_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100)")
def shap_topk(spark, d):
    top = read(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)
    return trees.top_attributions(top, "c_custkey", *trees.parse_model(MODEL), k=2, labels=_LABELS).withColumn("shap_value", F.round("shap_value", 6))


@query(_SHAP + "SELECT c_custkey, factor, round(x, 6) AS shap_value FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(abs(x), 9) DESC, factor) AS r FROM l) WHERE r = 1")
def shap_strongest(spark, d):
    """The strongest factor of every row."""
    return trees.top_attributions(read(spark, d, "customer"), "c_custkey", *trees.parse_model(MODEL), k=1).select("c_custkey", "factor", F.round("shap_value", 6).alias("shap_value"))


@query()
def train_ranker(spark, d):
    """Scores by trees trained on the records' own features; tests hold the training against plain gradients and splits."""
    found = stored(FE.static_features(_people(spark, d), Policy(reference_date=REF)), "features")  # for the cuts, the bins and the scores
    tier = (2 * F.col("role_target_best") + 2 * F.col("consistency_score")).cast("int")
    rows = found.withColumn("id", F.col("candidate_id").cast("long")).withColumn("tier", tier)
    names = sorted(FE.feature_columns(Policy()))
    model = boosting.train(rows, names, rounds=2, rate=0.3, depth=2)
    return rows.select("candidate_id", F.round(trees.predict_column(names, model), 6).alias("score"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_activity(spark, d):
    return live.activity(read(spark, d, "events")).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT name, count(v)::BIGINT AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS low, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS q2, round(quantile_cont(v, 0.75), 4) AS q3, max(v) AS high
FROM (SELECT 'c_acctbal' AS name, c_acctbal AS v FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::DOUBLE FROM customer) GROUP BY name""")
def summary_stats(spark, d):
    out = audit.describe(read(spark, d, "customer"), "c_acctbal", "c_nationkey")
    return out.select("name", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std")), "low", *(F.round(c, 4).alias(c) for c in ("q1", "q2", "q3")), "high")


@query("SELECT source, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) FILTER (lang = 'en') / count(*), 1) AS english, round(100.0::DOUBLE * count(*) FILTER (n_chars > 2000) / count(*), 1) AS long FROM documents GROUP BY source")
def group_shares(spark, d):
    return audit.shares(read(spark, d, "documents"), "source", {"english": F.col("lang") == "en", "long": F.col("n_chars") > 2000})


@query(_SCORED + "SELECT c_mktsegment AS segment, count(*)::BIGINT AS n FROM (SELECT id FROM z ORDER BY round(final, 6) DESC, id::VARCHAR LIMIT 100) JOIN customer ON c_custkey = id GROUP BY c_mktsegment")
def fairness_top(spark, d):
    segments = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    scored = _scored(spark, d).withColumn("final", F.round("final", 6)).join(segments, "id")
    return audit.fairness(scored, "segment", 100, F.desc("final"), F.col("candidate_id"))[0]


@query(_SCORED + "SELECT c_mktsegment AS segment, least(floor(final * 40), 39)::INT AS bin, count(*)::BIGINT AS n FROM z JOIN customer ON c_custkey = id WHERE final BETWEEN 0 AND 1 GROUP BY ALL")
def fairness_histogram(spark, d):
    segments = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    scored = _scored(spark, d).withColumn("final", F.round("final", 12)).join(segments, "id")
    return audit.fairness(scored, "segment", 100, F.desc("final"), F.col("candidate_id"))[1]


@query(_SCORED + "SELECT round(min(availability), 6) AS availability_low, round(max(availability), 6) AS availability_high, round(avg(availability), 6) AS availability_mean, 0.7::DOUBLE AS location_low, 0.7::DOUBLE AS location_high, 0.7::DOUBLE AS location_mean FROM z")
def modifier_ranges(spark, d):
    found = audit.fairness(_scored(spark, d).withColumn("segment", F.lit("all")), "segment", 100, F.desc("final"))[2]
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


_SINCE = "o_orderdate::DATE > (SELECT max(o_orderdate)::DATE - 365 FROM orders)"
_PROFILE_FLAGS = {"large": "o_totalprice > 200000", "open": "o_orderstatus = 'O'", "recent": _SINCE, "urgent": "o_orderpriority LIKE '1%'"}
_PROFILE_ROWS = "SELECT '{dim}' AS dimension, {group} AS value, '{name}' AS measure, count(*)::BIGINT AS n, count(*) FILTER ({flag})::BIGINT AS hits, round(100.0::DOUBLE * count(*) FILTER ({flag}) / count(*), 1) AS pct FROM orders {by}"


@query(" UNION ALL ".join(_PROFILE_ROWS.format(dim=dim, group=f"{dim}::VARCHAR" if dim != "all" else "NULL::VARCHAR", name=name, flag=flag, by=f"GROUP BY {dim}" if dim != "all" else "") for dim in ("all", "o_orderpriority", "o_orderstatus") for name, flag in _PROFILE_FLAGS.items()))
def profile(spark, d):
    """Flags by several groupings at once; the reference date is the newest one of the data."""
    orders = read(spark, d, "orders")
    newest = audit.newest(orders, F.to_date("o_orderdate"))
    rows = orders.crossJoin(F.broadcast(newest))  # one row
    flags = {"large": F.col("o_totalprice") > 200000, "open": F.col("o_orderstatus") == "O", "recent": F.to_date("o_orderdate") > F.date_sub("reference", 365), "urgent": F.col("o_orderpriority").startswith("1")}
    return audit.profile(rows, flags, ["o_orderpriority", "o_orderstatus"])


@query("""SELECT 'same' AS cache, 'reused' AS found, count(*)::BIGINT AS kept, 0::BIGINT AS encoded FROM embeddings UNION ALL SELECT 'turned', 'reordered', count(*), 0 FROM embeddings
UNION ALL SELECT 'partial', 'refilled', count(*) FILTER (vec_id % 7 <> 0), count(*) FILTER (vec_id % 7 = 0) FROM embeddings UNION ALL SELECT 'none', 'refilled', 0, count(*) FROM embeddings""")
def vector_cache(spark, d):
    """What of a vector cache is used again: everything, everything in another order, all but what is missing."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("place"), "embedding")
    texts = rows.select("id", "place", F.col("id").cast("string").alias("text"))
    caches = {"same": rows, "turned": rows.withColumn("place", -F.col("place")), "partial": rows.where("id % 7 <> 0"), "none": rows.where("false")}
    encode = lambda missing: missing.select("id", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    out = []
    for name, cache in caches.items():
        how, filled = vectors.filled(cache, texts, encode)
        out.append(filled.agg(F.lit(name).alias("cache"), F.lit(how).alias("found"), F.count_if(~F.col("new")).alias("kept"), F.count_if("new").alias("encoded")))
    return reduce(DataFrame.unionByName, out)


@query("SELECT count(*) FILTER (c_custkey % 11 <> 3)::BIGINT AS accepted, count(*) FILTER (c_custkey % 11 = 3)::BIGINT AS skipped FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def read_accounting(spark, d):
    """Records read once: what is good, what is kept aside, and their numbers, all from one scan."""
    path = work_path(spark, "records")
    text = F.when(F.col("id") % 11 == 3, F.substring("record", 1, 40)).otherwise(F.col("record"))
    _records(spark, d).select(text.alias("value")).write.text(f"{path}/in")
    return read_accounted(spark, f"{path}/in", f"{path}/good", f"{path}/bad")


@query("SELECT DISTINCT o_custkey::VARCHAR AS candidate_id, true AS stuffed_is_low, true AS impossible_is_low, true AS idle_is_lower FROM orders")
def misleading_records(spark, d):
    """Every record made to mislead: with all skills and nothing behind them, with an impossible career, idle."""
    return adversarial.properties(_people(spark, d), Policy(reference_date=REF))


@query("SELECT DISTINCT o_custkey::VARCHAR AS candidate_id, true AS key_order, true AS unknown_fields, true AS quoted_numbers FROM orders")
def metamorphic(spark, d):
    """Features of records that are written otherwise: keys in another order, unknown fields everywhere, numbers in quotes."""
    policy = Policy(reference_date=REF)
    records = stored(_records(spark, d).select("record"), "records")  # one text per record, however it is spelled afterwards
    ways = {"plain": lambda text: text, "key_order": rewrite.sorted_keys, "unknown_fields": rewrite.with_unknown_fields, "quoted_numbers": rewrite.with_quoted_numbers}
    of = lambda df: FE.static_features(typed(df.select(F.from_json("record", raw_schema()).alias("r")).select("r.*")), policy)
    digest = lambda df, name: of(df).select("candidate_id", F.lit(name).alias("way"), F.xxhash64(*sorted(FE.feature_columns(policy))).alias("h"))
    every = reduce(DataFrame.unionByName, (digest(records.select(way(F.col("record")).alias("record")), name) for name, way in ways.items()))
    of_way = lambda name: F.max(F.when(F.col("way") == name, F.col("h")))
    return every.groupBy("candidate_id").agg(*((of_way("plain") == of_way(name)).alias(name) for name in ways if name != "plain"))


@query("SELECT e.event_id, e.user_id, c_nationkey FROM events e JOIN customer ON c_custkey = e.user_id WHERE e.value > 50 AND e.ts::DATE = (SELECT max(ts)::DATE FROM events)")
def newest_activity(spark, d):
    events = read(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    last = audit.newest(events, F.col("day"))
    recent = events.join(F.broadcast(last), F.col("day") == F.col("reference")).where("value > 50")
    return recent.join(read(spark, d, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "user_id", "c_nationkey")
