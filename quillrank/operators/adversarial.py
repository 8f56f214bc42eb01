"""Records made to mislead a ranking, from any table of typed records, and what must hold for their scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.functions.policy import DEFAULT, Policy
from quillrank.operators.features import static_features
from quillrank.operators.scoring import score
from quillrank.sources.tables import stored


def _with(entities: DataFrame, column: str, values: dict[str, Column]) -> DataFrame:
    out = F.col(column)
    for name, value in values.items():
        out = out.withField(name, value.cast(entities.schema[column].dataType[name].dataType))
    return entities.withColumn(column, out)


def _array(entities: DataFrame, column: str, rows: list[dict]) -> Column:
    kind = entities.schema[column].dataType
    empty = {"string": "", "int": 0, "boolean": False}
    value = lambda row, f: F.lit(row.get(f.name, None if f.nullable else empty[f.dataType.simpleString()])).cast(f.dataType)
    made = [F.struct(*(value(row, f).alias(f.name) for f in kind.elementType.fields)) for row in rows]
    return F.array(*made) if made else F.array().cast(kind)


def stuffed(entities: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Every core skill at its best, never used, below a title off target and without a career."""
    skills = [{"name": n, "proficiency": "expert", "endorsements": 99, "duration_months": 0} for n in policy.core_skills]
    out = _with(entities, "profile", {"current_title": F.lit(policy.off_target_titles[0])})
    return out.withColumn("career_history", _array(out, "career_history", [])).withColumn("skills", _array(out, "skills", skills))


def impossible(entities: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Three years of experience, 200 months of them in a role that began three years ago."""
    start = f"{int(policy.reference_date[:4]) - 3}{policy.reference_date[4:]}"
    role = {"title": policy.target_titles[0], "description": policy.core_skills[0], "company": "any", "start_date": start, "duration_months": 200, "is_current": True}
    return _with(entities, "profile", {"years_of_experience": F.lit(3.0)}).withColumn("career_history", _array(entities, "career_history", [role]))


def engaged(entities: DataFrame, policy: Policy = DEFAULT, days: int = 7, answers: float = 0.8, open_: bool = True) -> DataFrame:
    """Last seen so many days before the reference date, answering such a share."""
    seen = F.date_sub(F.to_date(F.lit(policy.reference_date)), days).cast("string")
    return _with(entities, "signals", {"last_active_date": seen, "recruiter_response_rate": F.lit(answers), "applications_submitted_30d": F.lit(4), "open_to_work_flag": F.lit(open_)})


def idle(entities: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    return engaged(entities, policy, 360, 0.05, False)


def properties(entities: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """candidate_id, stuffed_is_low, impossible_is_low, idle_is_lower: per record, whether the gates hold for what is made of it.

    A stuffed record stays below the off-target gate, an impossible one below the gate of
    contradictions (times the best modifiers), and an idle record below an engaged one.
    """
    best = policy.availability_band[1] * policy.location_band[1]
    entities = stored(entities, "entities")  # built once, read for each of the four
    final = lambda df, name: score(static_features(df, policy), policy).select("candidate_id", F.lit(name).alias("made"), "final")
    made = {"stuffed": stuffed, "impossible": impossible, "engaged": engaged, "idle": idle}
    every = reduce(DataFrame.unionByName, (final(make(entities, policy), name) for name, make in made.items()))
    out = every.groupBy("candidate_id").agg(*(F.max(F.when(F.col("made") == name, F.col("final"))).alias(name) for name in made))
    slack = 1e-9
    return out.select(
        "candidate_id",
        (F.col("stuffed") <= policy.off_target_gate * best + slack).alias("stuffed_is_low"),
        (F.col("impossible") <= policy.consistency_gate * best + slack).alias("impossible_is_low"),
        (F.col("idle") <= F.col("engaged") + slack).alias("idle_is_lower"),
    )
