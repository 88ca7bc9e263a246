"""Accuracy, pivots, rollups and transitions over scored rows; one pass each, ratios safe for empty groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b rounded, 0.0 where b is 0."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), digits)


def accuracy(scored: DataFrame, correct: Column, choice: Column) -> DataFrame:
    """Totals, correct rows and accuracy, overall and for multiple choice and free answers."""
    right, total = F.count_if(correct), F.count("*")
    parts = {"total": total, "correct": right, "accuracy": ratio(right, total)}
    for name, test in (("mcq", choice), ("free", ~choice)):
        n, ok = F.count_if(test), F.count_if(test & correct)
        parts |= {f"{name}_total": n, f"{name}_correct": ok, f"{name}_accuracy": ratio(ok, n)}
    return scored.agg(*(c.alias(k) for k, c in parts.items()))


def rolled_up(rows: DataFrame, key: str, *measures: Column) -> DataFrame:
    """Measures by key and over all, the row over all flagged by is_total."""
    return rows.rollup(key).agg(F.grouping(key).cast("int").alias("is_total"), *measures)


def pivoted(rows: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """A row a key with a count for each of the kinds named, in one aggregation."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds))


def summary(rows: DataFrame, by: list[str], correct: Column, error: str, errors: list[str]) -> DataFrame:
    """n, correct, acc (0 for none) and a count of each error named, by type, prompt, configuration or what else ``by`` says, in one aggregation."""
    ok = F.count_if(F.coalesce(correct, F.lit(False)))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), ok.alias("correct"), F.coalesce(F.try_divide(ok, F.count("*")), F.lit(0.0)).alias("acc"), *(F.count_if(F.col(error) == e).alias(f"err_{e}") for e in errors))


def format_measures(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts and means of how responses are formed, in one pass; by group or over all.

    rows: finish ("" or null: not known), is_mcq, letter, items (how many answers were extracted; 0: none) and gold (how many there are), response, raw, and the flags
    fallback_used, stage0_repair_used and postprocess_used (null: no). A cut-off row is one whose finish is known and not "stop".
    """
    finish, letter = F.lower(F.coalesce("finish", F.lit(""))), F.coalesce("letter", F.lit(""))
    free, none = ~F.col("is_mcq"), F.coalesce("items", F.lit(0)) == 0
    tests = {
        "truncation_count": (finish != "") & (finish != "stop"), "no_extraction_count": free & none, "count_mismatch_count": free & ~none & (F.col("items") != F.col("gold")), "mcq_format_error_count": F.col("is_mcq") & (letter == ""),
        "fallback_used": F.col("fallback_used"), "stage0_repair_used": F.col("stage0_repair_used"), "postprocess_used": F.col("postprocess_used"), "free_total": free, "mcq_total": F.col("is_mcq"),
    }
    length = lambda c: F.coalesce(F.avg(F.length(F.coalesce(c, F.lit("")))), F.lit(0.0))
    out = rows.groupBy(*by).agg(*(F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()), length("response").alias("avg_response_chars"), length("raw").alias("avg_raw_response_chars"))
    return out.withColumn("format_error_count", F.col("no_extraction_count") + F.col("count_mismatch_count") + F.col("mcq_format_error_count"))


def transitions(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """Counts of the four outcomes of a change, zeros included."""
    names = {(True, True): "both_correct", (True, False): "lost", (False, True): "gained", (False, False): "both_wrong"}
    kind = None
    for (a, b), name in names.items():
        test = (before == a) & (after == b)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    counts = rows.select(kind.alias("group")).groupBy("group").agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(n,) for n in names.values()], "group string")
    return every.join(counts, "group", "left").select("group", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def counted(rows: DataFrame, values: str, name: str) -> DataFrame:
    """How often each element of an array column stands in it, over all rows."""
    return rows.select(F.explode(values).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def majority(votes: DataFrame, key: str, choice: str, position: str) -> DataFrame:
    """The most frequent choice that isn't empty, its votes and the position of its first vote; ties to the earliest.

    Votes are counted before any ordering, so a key with very many votes is one row a choice when it is ranked.
    Keys with empty choices only have choice "" with no votes.
    """
    counted = votes.groupBy(key, choice).agg(F.count("*").alias("votes"), F.min(position).alias("first_position"))
    real = F.coalesce(F.col(choice), F.lit("")) != ""
    best = F.max(F.when(real, F.struct(F.col("votes"), -F.col("first_position"), F.col(choice))))
    return counted.groupBy(key).agg(best.alias("b"), F.sum("votes").alias("samples"), F.min("first_position").alias("f")).select(key, F.coalesce(F.col(f"b.{choice}"), F.lit("")).alias(choice), F.coalesce("b.votes", F.lit(0)).cast("long").alias("votes"), F.coalesce(-F.col("b.col2"), F.col("f")).alias("first_position"), F.col("samples").cast("long").alias("samples"))


def best_combination(runs: DataFrame, kind: str, order: list[str]) -> DataFrame:
    """The best run of each kind by accuracy (correct of n; the first in ``order`` of equal ones), and all of the best together, whose kind is null."""
    accuracy_ = F.coalesce(F.try_divide(F.col("correct"), F.col("n")), F.lit(0.0))
    best = F.min(F.struct((-accuracy_).alias("__a"), *order, "n", "correct")).alias("b")
    each = runs.groupBy(kind).agg(best).select(kind, *(F.col(f"b.{c}").alias(c) for c in [*order, "n", "correct"]))
    whole = each.agg(F.lit(None).cast(runs.schema[kind].dataType).alias(kind), *(F.lit(None).cast(runs.schema[c].dataType).alias(c) for c in order), F.sum("n").alias("n"), F.sum("correct").alias("correct"))
    return each.unionByName(whole).withColumn("accuracy", ratio(F.col("correct"), F.col("n")))


def planned(experiments: DataFrame, key: str, splits: list[str], once: tuple[str, ...] = ("train", "merge"), each: tuple[str, ...] = ("eval", "score")) -> DataFrame:
    """The stages of each experiment in order: those that run once, then for each split those that run on it."""
    stages = [*once, *(f"{stage}_{split}" for split in splits for stage in each)]
    listed = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(s).alias("stage")) for i, s in enumerate(stages)))
    return experiments.select(key, F.explode(listed).alias("s")).select(key, "s.position", "s.stage")
