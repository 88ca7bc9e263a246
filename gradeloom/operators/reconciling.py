"""Inputs against outputs and failures: which state each row is in, and counts of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("success", "invalid", "conflicting", "duplicate", "failed", "missing", "orphan")


def states(inputs: DataFrame, outputs: DataFrame, failures: DataFrame, key: str, errors: Column) -> DataFrame:
    """key, state, outputs and error of every input and of every output without one.

    ``errors``: an array of what is wrong with an output, over its columns. An input with an output that has errors is invalid, with several outputs a duplicate, with an output
    and a failure conflicting, with neither missing; an output whose key is no input is an orphan. Each side is counted by key first, so a key that
    repeats, however often, is one row in the joins; null keys are no inputs, and outputs with one are orphans.
    """
    bad = F.array_join(errors, "; ")
    made = outputs.select(key, bad.alias("__error")).groupBy(key).agg(F.count("*").alias("__n"), F.max(F.nullif("__error", F.lit(""))).alias("__error"))
    lost = failures.select(key).distinct().withColumn("__failed", F.lit(True))
    asked = inputs.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("__asked", F.lit(True))
    joined = asked.join(made, key, "full_outer").join(lost, key, "left")
    has, failed = F.col("__n").isNotNull(), F.coalesce("__failed", F.lit(False))
    state = (
        F.when(F.col("__asked").isNull(), "orphan").when(has & F.col("__error").isNotNull(), "invalid").when(has & failed, "conflicting").when(has & (F.col("__n") > 1), "duplicate")
        .when(has, "success").when(failed, "failed").otherwise("missing")
    )
    return joined.select(key, state.alias("state"), F.coalesce("__n", F.lit(0)).alias("outputs"), "__error").withColumnRenamed("__error", "error")


def counts(rows: DataFrame) -> DataFrame:
    """One row: how many keys there are, how many in each state, and whether all inputs are accounted for and nothing is wrong."""
    each = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    sound = F.count_if(~F.col("state").isin("success", "failed")) == 0
    return rows.agg(F.count("*").alias("keys"), *each, sound.alias("complete"))
