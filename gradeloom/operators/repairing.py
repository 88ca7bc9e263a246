"""Staged fallback over candidate responses, and the checks of worker records. Generation is outside: candidates are a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A

STAGES = ("repair", "continuation", "bounded", "high_budget")


def staged(rows: DataFrame, candidates: DataFrame, key: str, stages: tuple[str, ...], accept: Column) -> DataFrame:
    """The first stage's candidate that ``accept`` takes (over response and finish_reason), else the row's own response.

    candidates: key, stage, response, finish_reason. Only rows without an accepted stage so far reach the next one. Stages are few and a
    row's attempts are at most one a stage, so the machine is one join and an ordered scan of a short array, not a loop of jobs.
    """
    order = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    tried = candidates.filter(F.col("stage").isin(*stages)).withColumns({"order": order, "accepted": F.coalesce(accept, F.lit(False))})
    attempts = tried.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("order", "stage", "response", "finish_reason", "accepted"))).alias("__a"))  # at most a row a stage
    joined = rows.join(attempts, key, "left").withColumn("__ok", F.filter("__a", lambda a: a["accepted"]))
    first = F.get("__ok", F.lit(0))
    used = F.when(first.isNotNull(), F.array_size(F.filter("__a", lambda a: a["order"] <= F.get("__ok", F.lit(0))["order"]))).otherwise(F.coalesce(F.array_size("__a"), F.lit(0)))
    return joined.select(*(c for c in rows.columns if c != "response"), F.coalesce(first["response"], F.col("response")).alias("response"), F.coalesce(first["stage"], F.lit("none")).alias("stage"), used.cast("long").alias("attempts"))


#: Errors of format, after which a response is asked for once more.
FORMAT_FAILURES = ("truncated", "no_answer", "out_of_range", "count_mismatch")


def retried_once(rows: DataFrame, replies: DataFrame, key: str, columns: list[str], error: str = "error_type", failures: tuple[str, ...] = FORMAT_FAILURES) -> DataFrame:
    """``rows`` whose error is one of format with the reply's ``columns`` and error instead, if the reply's error isn't one; ``fallback_used`` says where."""
    other = replies.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in [*columns, error]))
    fails = F.col(error).isin(*failures)
    joined = rows.join(other, (F.col(key) == F.col("__k")) & fails, "left")
    used = F.col("__k").isNotNull() & ~F.col(f"__{error}").isin(*failures)
    return joined.select(*(F.when(used, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in (*columns, error) else F.col(c) for c in rows.columns), used.alias("fallback_used"))


def acceptable(response: Column, finish: Column) -> Column:
    """A response with an answer that isn't cut-off reasoning."""
    group = A.last_box_group(A.after_think(response))
    answer = F.array_join(group, ", ")
    return (F.size(group) > 0) & ~((F.coalesce(finish, F.lit("")) == "length") & A.looks_like_reasoning(answer))


def budgets(first: int, cap: int) -> list[int]:
    """Token budgets of a doubling retry: from the first to the cap."""
    out = []
    while first <= cap:
        out.append(first)
        first *= 2
    return out


#: A worker record's keys, its source and its longest reasoning.
WORKER_KEYS = ("id", "instruction", "reasoning", "output", "warning", "source")
WORKER_SOURCE, WORKER_WORDS = "worker_single", 320


def worker_errors(record: str, source: str) -> Column:
    """What is wrong with a worker record (a struct column) against its task (a struct column), as an array of messages."""
    r, s = F.col(record), F.col(source)
    text = F.coalesce(r["reasoning"], F.lit(""))
    low = F.lower(text)
    tests = [
        (~r["id"].cast("string").eqNullSafe(s["id"].cast("string")), "id changed"),
        (~r["instruction"].eqNullSafe(s["instruction"]), "instruction changed"),
        (~r["output"].eqNullSafe(s["output"]), "output changed"),
        (F.trim(text) == "", "reasoning missing or empty"),
        (F.regexp_count(text, F.lit(r"\S+")) > WORKER_WORDS, f"reasoning exceeds {WORKER_WORDS} words"),
        (low.contains("final_answers"), "reasoning contains FINAL_ANSWERS"),
        (text.contains("\\boxed"), "reasoning contains boxed final answer"),
        (low.contains("<think") | low.contains("</think>"), "reasoning contains think tags"),
        (r["warning"].isNull(), "warning is missing or not a string"),
        (~r["source"].eqNullSafe(F.lit(WORKER_SOURCE)), f"source must be {WORKER_SOURCE}"),
    ]
    return F.array_compact(F.array(*(F.when(t, m) for t, m in tests)))


def key_errors(json: Column) -> Column:
    """Missing and unexpected keys of a record given as JSON text; a text that is fenced or no object is an error itself."""
    keys, want = F.json_object_keys(json), F.array(*map(F.lit, WORKER_KEYS))
    missing, extra = F.array_sort(F.array_except(want, keys)), F.array_sort(F.array_except(keys, want))
    named = lambda label, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{label}: "), F.array_join(a, ", ")))
    bad = F.trim(json).startswith("```") | keys.isNull()
    return F.when(bad, F.array(F.lit("not a JSON object"))).otherwise(F.array_compact(F.array(named("missing keys", missing), named("unexpected keys", extra))))


def collected(requests: DataFrame, results: DataFrame, key: str = "custom_id") -> DataFrame:
    """State of each request of a batch: done, failed (a status but 200, or no content), unseen, or unknown (a result nobody asked for)."""
    body = F.get_json_object("body", "$.response.body.choices[0].message.content")
    status = F.get_json_object("body", "$.response.status_code").try_cast("int")
    got = results.select(F.col(key), body.alias("content"), status.alias("status"), F.lit(True).alias("__got"))
    joined = requests.withColumn("__asked", F.lit(True)).join(got, key, "full_outer")
    state = F.when(F.col("__asked").isNull(), "unknown").when(F.col("__got").isNull(), "unseen").when((F.col("status") != 200) | F.col("content").isNull(), "failed").otherwise("done")
    return joined.withColumn("state", state).drop("__asked", "__got")
