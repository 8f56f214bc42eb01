"""Explanations of ranked rows, from facts that the rows and records hold: columns, no Python.

Two sentences: who it is and what they built (in their own words), then depth, place,
engagement and concerns. Wording varies with the digits of the id, tone with the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.exprs import fixed, python_int
from quillrank.functions.lexicon import first_clause

# fixed values: least scores of the tones, least years that are told, limits of engagement and notice
TONES = ((0.66, "strong"), (0.40, "good"), (0.22, "partial"))
WEAK = "weak"
TOLD_YEARS, ENGAGED, AWAY, LONG_NOTICE, MOST_CONCERNS = 2.0, (0.8, 0.55), (0.45, 0.2), 60, 2
DEPTH = (("embedding_retrieval_signal", "core methods"), ("vector_db_signal", "data stores"), ("eval_framework_signal", "evaluation"))


def tone(score: Column) -> Column:
    out = F.lit(WEAK)
    for least, name in reversed(TONES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def _present(*parts: Column) -> Column:
    """An array of the parts that are not null or empty."""
    return F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))


def _upper(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def reason(names: set[str]) -> Column:
    """The text of a row that has facts (title, years, place, country, phrase, response, notice, vid) and features; those not in `names` are 0."""
    g = lambda name: F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0)) if name in names else F.lit(0.0)
    on = lambda name: g(name) > 0
    score = g("final") if "final" in names else g("fit_raw")
    way = lambda *texts: F.element_at(F.array(*texts), (F.pmod("vid", F.lit(3)) + 1).cast("int"))

    title = F.when(F.col("title") == "", "no title").otherwise(F.col("title"))
    years = fixed(F.col("years"), 1)
    applied = g("applied_ml_years")
    told = F.when(((g("role_target_best") >= 1) | on("relevant_history_flag")) & (applied >= TOLD_YEARS), F.concat(F.lit(", some "), fixed(applied, 0), F.lit(" of them applied"))).otherwise("")
    opener = way(F.concat(title, F.lit(" with "), years, F.lit(" yrs"), told), F.concat(years, F.lit(" yrs"), told, F.lit(", currently "), title), F.concat(title, F.lit(", "), years, F.lit(" yrs of experience"), told))

    quote = F.when((on("ever_built_relevant_flag") | on("production_signal")) & F.col("phrase").isNotNull(), F.concat(way(F.concat(tone(score), F.lit(" record")), F.lit("has built"), F.concat(tone(score), F.lit(" practice"))), F.lit(': "'), F.col("phrase"), F.lit('"')))
    depth = F.array_join(_present(*(F.when(on(flag), name) for flag, name in DEPTH)), ", ")
    depth = F.when(depth != "", way(F.concat(depth, F.lit(" in the record")), F.concat(F.lit("shows "), depth), F.concat(F.lit("record covers "), depth)))

    moves = F.when(on("willing_to_relocate_flag"), ", would move")
    home = F.when(F.col("place") == "", "home country").otherwise(F.col("place"))
    place = F.when(g("location_tier_score") >= 1, F.concat(F.lit("based in "), F.col("place"), F.lit(" (preferred)"))).when(on("in_india_flag"), F.concat(home, F.coalesce(moves, F.lit("")))).otherwise(F.concat(F.col("country"), F.coalesce(moves, F.lit(" (abroad)"))))

    rate, days = fixed(F.col("response"), 2), g("days_since_active").cast("int").cast("string")
    engaged = F.when((g("recency_score") >= ENGAGED[0]) & (g("response_rate_score") >= ENGAGED[1]), F.concat(F.lit("answers ("), rate, F.lit("), active of late")))
    engaged = engaged.when((g("recency_score") < AWAY[0]) | (g("response_rate_score") < AWAY[1]), F.concat(F.lit("hard to reach (answers "), rate, F.lit(", away for "), days, F.lit(" days)")))

    concerns = F.slice(
        _present(
            F.when(on("is_offtarget_current") & ~on("relevant_history_flag"), "current role is off target"),
            F.when(g("services_fraction") >= 0.9, "services-only career"),
            F.when(on("honeypot_flag"), "the record contradicts itself"),
            F.when(on("cv_dominant_flag"), "main field is another one"),
            F.when(on("langchain_only_recent_flag"), "tools only, little below them"),
            F.when(F.col("notice") > LONG_NOTICE, F.concat(F.col("notice").cast("string"), F.lit(" days of notice"))),
        ),
        1,
        MOST_CONCERNS,
    )
    concern = F.when(F.size(concerns) > 0, F.concat(F.lit("concerns: "), F.array_join(concerns, ", "))).when(score < TONES[-1][0], "near the cut")
    odd = F.pmod("vid", F.lit(2)) == 1
    tail = F.when(odd, F.array_join(_present(depth, engaged, place, concern), "; ")).otherwise(F.array_join(_present(depth, place, engaged, concern), "; "))
    first = F.concat(_upper(F.array_join(_present(opener, quote), "; ")), F.lit("."))
    return F.concat(first, F.when(tail != "", F.concat(F.lit(" "), _upper(tail), F.lit("."))).otherwise(""))


def facts(entities: DataFrame) -> DataFrame:
    """candidate_id and what reason() needs of a record; the phrase is the first clause of four words that a role has."""
    clauses = F.filter(F.transform("career_history", lambda e: first_clause(e["description"])), lambda c: c.isNotNull())
    return entities.select(
        "candidate_id",
        F.col("profile.current_title").alias("title"),
        F.col("profile.years_of_experience").alias("years"),
        F.col("profile.location").alias("place"),
        F.col("profile.country").alias("country"),
        F.get(clauses, F.lit(0)).alias("phrase"),
        F.col("signals.recruiter_response_rate").alias("response"),
        F.col("signals.notice_period_days").alias("notice"),
        python_int(F.col("candidate_id")).alias("vid"),
    )


def explain(top: DataFrame, entities: DataFrame) -> DataFrame:
    """`top` (rank_top's rows) with `reasoning`; the entities are read by a broadcast of the top ids."""
    ids = F.broadcast(top.select("candidate_id"))  # at most the n of rank_top
    known = facts(entities.join(ids, "candidate_id", "left_semi"))
    taken = ("title", "years", "place", "country", "phrase", "response", "notice", "vid")
    rows = top.select("candidate_id", *(F.col(c) for c in top.columns if c != "candidate_id" and c not in taken)).join(known, "candidate_id")
    texts = rows.select("candidate_id", reason(set(rows.columns)).alias("reasoning"))
    return top.join(texts, "candidate_id").select(*top.columns, "reasoning")
