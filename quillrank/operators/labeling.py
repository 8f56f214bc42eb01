"""Offline labels from a judge: messages, rate-limited calls, tolerant parsing, resume."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.sources.store import remaining

JUDGMENT = "tier string, reasoning string, key_factors array<string>"


def message(entity: DataFrame, rubric: str, lists: int = 5, chars: int = 280) -> Column:
    """One JSON text per entity: the rubric and the entity with capped lists and strings."""
    fields = []
    for f in entity.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() == "array":
            c = F.slice(c, 1, lists)
        elif f.dataType.typeName() == "string":
            c = F.substring(c, 1, chars)
        fields.append(c.alias(f.name))
    return F.to_json(F.struct(F.lit(rubric).alias("system"), F.to_json(F.struct(*fields)).alias("user")))


def parse_judgment(reply: Column) -> Column:
    """struct(tier 0..4, reasoning <= 400 chars, <= 6 factors <= 60 chars); null for what is no judgment.

    Code fences are taken off; a reply that is not JSON is searched for its widest {...}.
    """
    bare = F.trim(F.regexp_replace(reply, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    parsed = F.coalesce(F.when(bare.startswith("{"), F.from_json(bare, JUDGMENT)), F.from_json(F.when(inner != "", inner), JUDGMENT))
    tier = parsed["tier"].try_cast("double").try_cast("int")
    factors = F.transform(F.slice(F.coalesce(parsed["key_factors"], F.array().cast("array<string>")), 1, 6), lambda x: F.substring(x, 1, 60))
    ok = F.struct(F.least(F.lit(4), F.greatest(F.lit(0), tier)).alias("tier"), F.substring(F.coalesce(parsed["reasoning"], F.lit("")), 1, 400).alias("reasoning"), factors.alias("key_factors"))
    return F.when(tier.isNotNull(), ok)


class Bucket:
    """A token bucket: at most `rate` per minute, `rate` at once."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.level, self.clock, self.sleep = rate, rate, clock, sleep
        self.at = clock()

    def take(self, amount: float = 1.0) -> None:
        amount = min(amount, self.rate)
        while True:
            now = self.clock()
            self.level = min(self.rate, self.level + (now - self.at) * self.rate / 60)
            self.at = now
            if self.level >= amount:
                self.level -= amount
                return
            self.sleep((amount - self.level) * 60 / self.rate)


class QuotaExhausted(Exception):
    """A judge's daily quota is used up."""


def pause_of(error: Exception) -> float | None:
    """Seconds that an error asks to wait: its retry_after, or "try again in 1m2.5s" in its text."""
    hint = getattr(error, "retry_after", None)
    if hint is not None:
        return float(hint)
    found = re.search(r"try again in (?:(\d+)m)?(?:([\d.]+)s)?", str(error), re.IGNORECASE)
    if not found or not any(found.groups()):
        return None
    return 60.0 * int(found[1] or 0) + float(found[2] or 0)


def with_retry(call: Callable[[], str], tries: int = 6, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """`call` with growing pauses; None when the tries are used up, QuotaExhausted passes through."""
    for i in range(tries):
        try:
            return call()
        except QuotaExhausted:
            raise
        except Exception as error:
            hint = pause_of(error)
            sleep(hint if hint is not None else min(30.0, 2.0 * 2**i + 1))
    return None


def judge(messages: DataFrame, key: str, client: Callable[[str], str], per_minute: float, partitions: int, tokens_per_minute: float | None = None) -> DataFrame:
    """(key, reply) of each message; the total rates are shared out evenly over the partitions.

    A message counts as a quarter of its characters in tokens. A client that has used up
    its quota gives null for the messages that are left in the partition.
    """

    def run(frames: Iterator):
        import pandas as pd

        requests = Bucket(per_minute / partitions)
        tokens = Bucket(tokens_per_minute / partitions) if tokens_per_minute else None
        spent = False
        for frame in frames:
            replies = []
            for text in frame["message"]:
                reply = None
                if not spent:
                    requests.take()
                    if tokens:
                        tokens.take(max(1, len(text) // 4))
                    try:
                        reply = with_retry(lambda t=text: client(t))
                    except QuotaExhausted:
                        spent = True
                replies.append(reply)
            yield pd.DataFrame({key: frame[key], "reply": replies})

    kind = messages.schema[key].dataType.simpleString()
    return messages.select(key, "message").repartition(partitions).mapInPandas(run, f"{key} {kind}, reply string")


def judge_all(messages: DataFrame, key: str, clients: list[Callable[[str], str]], path: str, per_minute: float, partitions: int, tries: int = 3, tokens_per_minute: float | None = None) -> DataFrame:
    """(key, reply) of every message that a client answers, kept as JSON under `path`.

    Messages without a reply go to the next client, `tries` times round; what `path` holds
    is not asked again, so a run that was broken off goes on where it stopped.
    """
    spark = messages.sparkSession
    schema = f"{key} {messages.schema[key].dataType.simpleString()}, reply string"
    spark.createDataFrame([], schema).write.mode("append").json(path)
    for client in clients * tries:
        left = open_messages(messages, spark.read.schema(schema).json(path), key)
        if left.isEmpty():
            break
        judge(left, key, client, per_minute, partitions, tokens_per_minute).where("reply IS NOT NULL").write.mode("append").json(path)
    return spark.read.schema(schema).json(path)


def open_messages(messages: DataFrame, checkpoint: DataFrame, key: str) -> DataFrame:
    """Messages that have no judgment yet."""
    return remaining(messages, checkpoint, key)
