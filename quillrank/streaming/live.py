"""Live scoring of arriving records: frozen statistics, appends that a repeated batch does not double, bounded state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.policy import DEFAULT, Policy
from quillrank.operators.features import static_features
from quillrank.operators.scoring import blended, with_modifiers, with_rubric
from quillrank.plans.rank import feature_store
from quillrank.sources.entities import raw_schema, typed
from quillrank.sources.store import latest


def entity_stream(spark: SparkSession, path: str, signals: str = "signals") -> DataFrame:
    return typed(spark.readStream.schema(raw_schema(signals)).json(path), signals)


def score_stream(entities: DataFrame, stats: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Scores per arriving record; `stats` is one row (dense_margin_low, dense_margin_high)."""
    return with_modifiers(blended(with_rubric(static_features(entities, policy), policy, stats), None, policy), policy)


def live_features(upload: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Features of an upload: those of the store, but its BM25 statistics are the upload's own."""
    return feature_store(upload, policy)


def run_available(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, mode: str = "append") -> None:
    """Takes what has arrived since the last run through `work`, a micro-batch at a time, and keeps its rows under `path`.

    Each batch is written to a folder of its own number, which is replaced if the batch
    runs again: after a loss between the write and the commit nothing is there twice. The
    checkpoint remembers what has been read, so the next run goes on from there.
    """

    def keep(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def kept(spark: SparkSession, path: str) -> DataFrame | None:
    """What run_available() has kept, with the number of each row's batch; None before the first batch."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def scored_against(snapshot: DataFrame, key: str, score: Column) -> Callable[[DataFrame], DataFrame]:
    """Work of a batch: its rows joined with a frozen snapshot by `key` and scored; rows that it lacks have nulls."""
    return lambda batch: batch.join(snapshot, key, "left").withColumn("score", score)


def latest_stream(records: DataFrame, key: str, time: str, order: list[str], late: str = "1 day", size: str = "1 day") -> DataFrame:
    """The last record per key and window of `time`; state holds only windows that the watermark has not passed.

    To be run in update mode: a window's row comes again when it changes. Records later than
    `late` behind the newest are dropped.
    """
    columns = [c for c in records.columns if c != key]
    timed = records.withWatermark(time, late)
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("last")
    return timed.groupBy(F.window(time, size).alias("span"), key).agg(best).select(key, F.col("span.start").alias("span"), "last.*")


def latest_kept(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record per key of what latest_stream() has sent: the newest state of each window, the newest window of each key."""
    return latest(rows.drop("span", "batch"), key, [F.col(c) for c in order])


def activity(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events per type and window, with a watermark; works on batch frames too."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
