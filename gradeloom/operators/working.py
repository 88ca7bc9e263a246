"""Retry loops around an outside effect: the effect is a function from a DataFrame of tasks to one of results, or a table of replies that is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cutting import kept, many

#: Seconds before the second and later attempts.
PAUSES = (2, 5, 10)

Effect = Callable[[DataFrame, int], DataFrame]


def replayed(replies: DataFrame, key: str = "id") -> Effect:
    """An effect that answers from a table (key, attempt, ...), for tests and reruns."""
    return lambda tasks, attempt: tasks.select(key).join(replies.filter(F.col("attempt") == attempt).drop("attempt"), key)


def attempted(tasks: DataFrame, done: DataFrame, effect: Effect, valid, key: str = "id", retries: int = 3, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Results of tasks that aren't done yet, and the keys that failed every attempt.

    Each attempt runs the effect on what is left. Its results are written to ``folder`` before they are used, and a run over the same folder reads what is there, so
    an effect never runs twice for one attempt, whatever is lost; without a folder they are written for this run alone.
    """
    spark = tasks.sparkSession
    left, out = tasks.join(done, key, "left_anti"), None
    for attempt in range(1 + retries):
        if left.isEmpty():
            break

        def call(left=left, attempt=attempt) -> DataFrame:
            return effect(left, attempt).filter(valid).withColumn("attempts", F.lit(attempt + 1))

        got = kept(call, folder and f"{folder}/attempt={attempt}", spark)
        out = got if out is None else out.unionByName(got)
        left = left.join(many(got), key, "left_anti")
    if out is None:
        out = effect(left, 0).filter("false").withColumn("attempts", F.lit(0))
    return out, left.select(key)


def pause(attempt: int) -> int:
    """Seconds to wait before an attempt; none before the first."""
    return 0 if attempt == 0 else PAUSES[min(attempt, len(PAUSES)) - 1]


def retry_queue(tasks: DataFrame, outputs: DataFrame, invalid, key: str = "id") -> DataFrame:
    """Tasks whose output is invalid or missing, with the reason."""
    bad = outputs.filter(invalid).select(key).distinct().withColumn("__bad", F.lit(True))
    seen = outputs.select(key).distinct().withColumn("__seen", F.lit(True))
    joined = tasks.join(seen, key, "left").join(bad, key, "left")
    return joined.withColumn("reason", F.when(F.col("__bad"), "invalid").when(F.col("__seen").isNull(), "missing")).filter("reason IS NOT NULL").drop("__bad", "__seen")


def latest_states(log: DataFrame, key: str = "id") -> DataFrame:
    """The last state of each task in an append-only log (key, attempt, state)."""
    return log.groupBy(key).agg(F.max_by("state", F.struct("attempt", "state")).alias("state"), F.max("attempt").alias("attempt"))
