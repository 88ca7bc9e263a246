"""Staged fallback as a loop over a shrinking set: each stage's effect is called for the rows that no earlier one resolved, and for no others.

An effect stands for outside work (a model's continuation, a tool), so each call is written before anything is decided by it: an attempt that a lost executor, or a
new run over the same folder, finds written is read and not called again. What goes from attempt to attempt is the key and how the last response ended; rows
and responses stay where they are until the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cutting import cut, kept, many
from .repairing import budgets

#: From the rows to work on and a budget of tokens to key, response and finish_reason, at most a row a key; a key that it leaves out has no response.
Effect = Callable[[DataFrame, int], DataFrame]
CUT_OFF = "length"


@dataclass(frozen=True)
class Stage:
    """``cap``: the budget doubles up to it, each time for the rows that are still cut off. ``only``: which unresolved rows the stage takes, over the rows' columns and last_finish."""

    name: str
    effect: Effect
    budget: int = 0
    cap: int | None = None
    only: Column | None = None


@dataclass
class Outcome:
    rows: DataFrame
    attempts: DataFrame
    counts: DataFrame


def run(rows: DataFrame, stages: list[Stage], accept: Column, key: str = "id", folder: str | None = None) -> Outcome:
    """Runs the stages over ``rows`` (key, response, finish_reason and what effects need), whose own responses ``accept`` has turned down.

    ``accept`` is over response and finish_reason of an attempt. The outcome: ``rows`` with the accepted response, its stage ("none": the row's own
    response stays), budget and how many attempts the row took; ``attempts``: key, step, stage, budget, response, finish_reason, accepted; ``counts``: a row a step
    with how many rows were asked, answered, accepted and cut off, and how many are left.
    """
    spark = rows.sparkSession
    left = cut(rows.select(key, F.coalesce("finish_reason", F.lit("")).alias("last_finish")))
    logs, counts, step, now = [], [], 0, left.count()
    for stage in stages:
        for budget in budgets(stage.budget, stage.cap) if stage.cap else [stage.budget]:
            step += 1
            asked = rows.join(many(left), key)
            if stage.only is not None:
                asked = asked.filter(stage.only)
            if stage.cap:
                asked = asked.filter(F.lower("last_finish") == CUT_OFF)
            asked = cut(asked)
            n = asked.count()
            if not n:
                counts.append((step, stage.name, budget, 0, 0, 0, 0, now))
                continue

            def call(stage=stage, budget=budget, asked=asked, step=step) -> DataFrame:
                got = stage.effect(asked, budget).select(key, "response", "finish_reason")
                return got.select(key, F.lit(step).alias("step"), F.lit(stage.name).alias("stage"), F.lit(budget).alias("budget"), "response", "finish_reason", F.coalesce(accept, F.lit(False)).alias("accepted"))

            got = kept(call, folder and f"{folder}/step={step:03d}-{stage.name}-{budget}", spark)
            logs.append(got.select(key, "step", "stage", "budget", "response", "finish_reason", "accepted"))
            last = got.select(key, "accepted", F.coalesce("finish_reason", F.lit("")).alias("now_finish"))
            left = cut(many(left).join(many(last), key, "left").filter(~F.coalesce("accepted", F.lit(False))).select(key, F.coalesce("now_finish", "last_finish").alias("last_finish")))
            answered, taken, short = last.agg(F.count("*"), F.count_if("accepted"), F.count_if(~F.col("accepted") & (F.lower("now_finish") == CUT_OFF))).first()
            now = left.count()
            counts.append((step, stage.name, budget, n, answered, taken, short, now))
    kinds = "step int, stage string, budget int, asked long, answered long, accepted long, cut_off long, left long"
    table = spark.createDataFrame(counts, kinds)
    if not logs:
        attempts = rows.select(key, F.lit(0).alias("step"), F.lit("").alias("stage"), F.lit(0).alias("budget"), F.col("response").cast("string").alias("response"), F.col("finish_reason").cast("string").alias("finish_reason"), F.lit(False).alias("accepted")).filter("false")
    else:
        attempts = logs[0]
        for more in logs[1:]:
            attempts = attempts.unionByName(more)
    won = attempts.groupBy(key).agg(F.max_by(F.struct("response", "stage", "budget"), F.when(F.col("accepted"), F.col("step"))).alias("__won"), F.count("*").alias("__n"))
    joined = rows.join(many(won), key, "left")
    whole = joined.select(
        *(c for c in rows.columns if c not in ("response", "finish_reason")), F.when(F.col("__won").isNotNull(), F.col("__won.response")).otherwise(F.col("response")).alias("response"),
        F.coalesce("__won.stage", F.lit("none")).alias("stage"), F.col("__won.budget").alias("budget"), F.coalesce("__n", F.lit(0)).alias("attempts"),
    )
    return Outcome(whole, attempts, table)
