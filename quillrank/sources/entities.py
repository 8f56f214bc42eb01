"""Nested entity records from JSON: lenient leaves, declared types, defaults.

Every leaf is read as text and cast afterwards, so a number in quotes or 12.0 for an
integer costs no row. Nulls and values that do not cast take the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: field -> (type, default); fixed values: names and defaults of the record format.
PROFILE = {n: ("string", "") for n in ("anonymized_name", "headline", "summary", "location", "country", "current_title", "current_company", "current_company_size", "current_industry")} | {"years_of_experience": ("double", 0.0)}
CAREER = {n: ("string", "") for n in ("company", "title", "industry", "company_size", "description")} | {"start_date": ("string", None), "end_date": ("string", None), "duration_months": ("int", 0), "is_current": ("boolean", False)}
EDUCATION = {n: ("string", "") for n in ("institution", "degree", "field_of_study")} | {"start_year": ("int", None), "end_year": ("int", None), "grade": ("string", None), "tier": ("string", "unknown")}
SKILL = {"name": ("string", ""), "proficiency": ("string", "beginner"), "endorsements": ("int", 0), "duration_months": ("int", 0)}
CERTIFICATION = {"name": ("string", ""), "issuer": ("string", ""), "year": ("int", None)}
LANGUAGE = {"language": ("string", ""), "proficiency": ("string", "")}
SIGNALS = (
    {n: ("double", 0.0) for n in ("profile_completeness_score", "recruiter_response_rate", "avg_response_time_hours", "interview_completion_rate")}
    | {n: ("double", -1.0) for n in ("github_activity_score", "offer_acceptance_rate")}
    | {n: ("string", None) for n in ("signup_date", "last_active_date")}
    | {n: ("int", 0) for n in ("profile_views_received_30d", "applications_submitted_30d", "connection_count", "endorsements_received", "notice_period_days", "search_appearance_30d", "saved_by_recruiters_30d")}
    | {n: ("boolean", False) for n in ("open_to_work_flag", "willing_to_relocate", "verified_email", "verified_phone", "linkedin_connected")}
    | {"preferred_work_mode": ("string", "")}
)
LISTS = {"career_history": CAREER, "education": EDUCATION, "skills": SKILL, "certifications": CERTIFICATION, "languages": LANGUAGE}
CORRUPT = "_corrupt_record"


def raw_schema(signals: str = "signals") -> T.StructType:
    """The record with text leaves; `signals` names the field with behaviour signals."""
    flat = lambda fields: T.StructType([T.StructField(n, T.StringType()) for n in fields])
    extra = [T.StructField("skill_assessment_scores", T.MapType(T.StringType(), T.StringType())), T.StructField("expected_salary_range_inr_lpa", flat(("min", "max")))]
    fields = [T.StructField("candidate_id", T.StringType()), T.StructField("profile", flat(PROFILE))]
    fields += [T.StructField(n, T.ArrayType(flat(f))) for n, f in LISTS.items()]
    fields += [T.StructField(signals, T.StructType([*flat(SIGNALS).fields, *extra])), T.StructField(CORRUPT, T.StringType())]
    return T.StructType(fields)


def _leaf(value: Column, kind: str, default) -> Column:
    if kind == "int":
        value = value.try_cast("double").try_cast("int")
    elif kind != "string":
        value = value.try_cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind))


def typed(raw: DataFrame, signals: str = "signals", years_given: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed records with defaults; the signals field is called `signals` from here on.

    `years_given` names a column that tells records with years of experience from those
    where the default stands for them; columns in `keep` stay.
    """
    struct = lambda base, fields: F.struct(*(_leaf(base[n], k, d).alias(n) for n, (k, d) in fields.items()))
    element = lambda fields: lambda e: struct(e, fields)
    columns = [F.coalesce("candidate_id", F.lit("")).alias("candidate_id"), struct(F.col("profile"), PROFILE).alias("profile")]
    for name, fields in LISTS.items():
        columns.append(F.transform(F.coalesce(F.col(name), F.array().cast(raw.schema[name].dataType)), element(fields)).alias(name))
    s = F.col(signals)
    scores = F.coalesce(s["skill_assessment_scores"], F.create_map().cast("map<string,string>"))
    leaves = [_leaf(s[n], k, d).alias(n) for n, (k, d) in SIGNALS.items()]
    leaves.append(F.map_filter(F.transform_values(scores, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull()).alias("skill_assessment_scores"))
    salary = s["expected_salary_range_inr_lpa"]
    leaves.append(F.struct(*(_leaf(salary[n], "double", 0.0).alias(n) for n in ("min", "max"))).alias("expected_salary_range_inr_lpa"))
    if years_given:
        columns.append(F.col("profile.years_of_experience").try_cast("double").isNotNull().alias(years_given))
    return raw.select(*columns, F.struct(*leaves).alias("signals"), *keep)


def read_raw(spark: SparkSession, path: str, array: bool = False, signals: str = "signals") -> DataFrame:
    """JSON lines (split over tasks), or one JSON array or object per file."""
    return spark.read.schema(raw_schema(signals)).option("multiLine", array).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_entities(spark: SparkSession, path: str, mode: str = "strict", array: bool = False, limit: int | None = None, signals: str = "signals") -> DataFrame:
    """Typed records. strict: a malformed line fails the job when it is read; skip: it is left out."""
    raw = read_raw(spark, path, array, signals)
    if mode == "skip":
        raw = raw.where(F.col(CORRUPT).isNull() & F.col("candidate_id").isNotNull())
    else:
        ok = F.col(CORRUPT).isNull()
        raw = raw.where(F.when(ok, F.coalesce(F.length("candidate_id"), F.lit(0)) >= 0).otherwise(F.raise_error(F.concat(F.lit("malformed record: "), F.coalesce(CORRUPT, F.lit("")))).cast("boolean")))
    out = typed(raw, signals)
    return out if limit is None else out.limit(limit)


def skipped(spark: SparkSession, path: str, array: bool = False, signals: str = "signals") -> DataFrame:
    """One row: how many records a skip-mode read accepts and leaves out."""
    bad = F.col(CORRUPT).isNotNull() | F.col("candidate_id").isNull()
    return read_raw(spark, path, array, signals).agg(F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("skipped"))


def read_accounted(spark: SparkSession, path: str, good: str, bad: str, array: bool = False, signals: str = "signals") -> DataFrame:
    """One row (accepted, skipped) of a read that keeps typed records under `good` and the text of malformed ones under `bad`.

    The numbers come with the pass that writes, by an observation on the scan; the source is
    read once, and `bad` holds few rows that are set aside from what was written.
    """
    seen = Observation("records")
    wrong = F.col(CORRUPT).isNotNull() | F.col("candidate_id").isNull()
    raw = read_raw(spark, path, array, signals).withColumn("_bad", wrong)
    counted = raw.observe(seen, F.count_if(~F.col("_bad")).alias("accepted"), F.count_if(F.col("_bad")).alias("skipped"))
    both = typed(counted, signals, keep=("_bad", CORRUPT))
    both.write.mode("overwrite").partitionBy("_bad").parquet(good)
    written = spark.read.parquet(good)
    written.where(F.col("_bad").cast("boolean")).select(F.col(CORRUPT).alias("record")).write.mode("overwrite").parquet(bad)
    return spark.createDataFrame([(seen.get["accepted"], seen.get["skipped"])], "accepted long, skipped long")


def read_upload(spark: SparkSession, path: str, cap: int | None = 100, signals: str = "signals") -> DataFrame:
    """Typed records of an uploaded file: a JSON array, one object over many lines, or JSON lines.

    Malformed lines and what is no object are left out; `cap` bounds the records.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    first = lines.select(F.ltrim("value")).first()
    whole = bool(first) and (first[0].startswith("[") or first[0].startswith("{") and lines.where(F.from_json("value", "map<string, string>").isNotNull()).isEmpty())
    return read_entities(spark, path, "skip", whole, cap, signals)


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns, sorted."""
    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType))
