"""What the operators share: table access, the shared folder, null-safe columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quillrank.sources.tables import discard, shared_folder, stored  # noqa: F401

BATCH_BYTES = 4 << 20

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes: workers and JVM hold some megabytes of text, not Spark's 64.

    A bound that the session has set itself stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == str(64 << 20):
        spark.conf.set(name, BATCH_BYTES)


def need_numbers(df: DataFrame, column: str) -> None:
    """Stops by name where ids are no whole numbers, before a job fails on one of them."""
    kind = df.schema[column].dataType
    if not isinstance(kind, IntegralType):
        raise ValueError(f"{column} must be a whole number; it is {kind.simpleString()}")


def unused(name: str, taken: set[str]) -> str:
    """`name`, with underscores before it until no column of a table is called so (case aside)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    taken.add(name)
    return name


def clean_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")
