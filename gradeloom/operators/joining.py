"""Joins by id with checks: coverage, reconciliation, routing, precedence, as-of. The engine picks each join's strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows
from .cutting import cut


class MissingRows(ValueError):
    """A join that must find every row didn't."""


def require(probe: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Inner join; an error if a probe row has no match."""
    lost = probe.join(index, key, "left_anti").select(key).limit(5).collect()
    if lost:
        raise MissingRows(f"no match for {key} in {[r[0] for r in lost]}")
    return probe.join(index, key)


def covered(gold: DataFrame, *sides: DataFrame, key: str = "id") -> DataFrame:
    """gold joined with each side; an error if a side lacks an id of gold."""
    for side in sides:
        gold = require(gold, side, key)
    return gold


def reconciled(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A row a key of either side with its rows on each side and a state: matched, missing (right only), extra (left only), duplicate."""
    a = left.groupBy(key).agg(F.count("*").alias("left_rows"))
    b = right.groupBy(key).agg(F.count("*").alias("right_rows"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("left_rows", F.lit(0)).alias("left_rows"), F.coalesce("right_rows", F.lit(0)).alias("right_rows"))
    return both.withColumn("state", F.when(F.col("left_rows") == 0, "missing").when(F.col("right_rows") == 0, "extra").when(F.col("left_rows") > 1, "duplicate").otherwise("matched"))


def routed(base: DataFrame, other: DataFrame, key: str, to_other: Column, value: str, names: tuple[str, str] = ("base", "other")) -> DataFrame:
    """For each base row the other's value where ``to_other`` holds and it is there, else its own; ``source`` says which."""
    got = other.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    use = to_other & F.col("__v").isNotNull()
    joined = base.join(got, F.col(key) == F.col("__k"), "left")
    return joined.select(*(c for c in base.columns if c != value), F.when(use, F.col("__v")).otherwise(F.col(value)).alias(value), F.when(use, names[1]).otherwise(names[0]).alias("source"))


def merged(order: DataFrame, key: str, **sources: DataFrame) -> DataFrame:
    """Rows of several tables, ``source`` naming each one's, in the places of ``order`` (key, position); of a key in several the first named counts."""
    ranked = None
    for i, (name, rows) in enumerate(sources.items()):
        one = rows.withColumns({"source": F.lit(name), "__p": F.lit(i)})
        ranked = one if ranked is None else ranked.unionByName(one, allowMissingColumns=True)
    return latest(ranked, [key], F.asc("__p")).drop("__p").join(order, key)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in ``order``. Each task keeps its first row of a key before rows move, so a hot key is a row a task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").select(*keys, *rest)


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def as_of(events: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each mark with the last event of its key at or before it: one sort a key, not a product of both sides.

    Events and marks have ``key`` and ``at``; events a ``value``; marks keep their columns and get ``<value>`` and ``<at>_found``.
    Of events at one time the largest value counts.
    """
    rest = [c for c in marks.columns if c not in (key, at)]
    e = events.select(key, at, F.struct(F.col(at).alias("t"), F.col(value).alias("v")).alias("__e"), *(F.lit(None).cast(marks.schema[c].dataType).alias(c) for c in rest), F.lit(0).alias("__mark"))
    m = marks.select(key, at, F.lit(None).cast(e.schema["__e"].dataType).alias("__e"), *rest, F.lit(1).alias("__mark"))
    w = Window.partitionBy(key).orderBy(at, "__mark", F.col("__e.v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = e.unionByName(m).withColumn("__e", F.last("__e", ignorenulls=True).over(w)).filter("__mark = 1")
    return found.select(key, at, *rest, F.col("__e.v").alias(value), F.col("__e.t").alias(f"{at}_found"))


def without(rows: DataFrame, text: str, other: DataFrame) -> DataFrame:
    """Rows whose text equals none of ``other`` (one text column). Texts meet by 128 bits of hash, which alone are shuffled for ``other``'s side."""
    wide = lambda c: [F.xxhash64(F.lit(i), c) for i in (1, 2)]
    a, b = wide(F.col(text))
    x, y = wide(F.col(other.columns[0]))
    known = other.select(x.alias("__x"), y.alias("__y")).distinct()
    return rows.withColumns({"__a": a, "__b": b}).join(known, (F.col("__a") == F.col("__x")) & (F.col("__b") == F.col("__y")), "left_anti").drop("__a", "__b")


def phrases(texts: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, anchor: int = 5, block: int = windows.BLOCK) -> DataFrame:
    """Pairs of a text and an item whose words stand in it one after another; see ``windows``. Items with fewer words than the anchor are looked up by all of their words.

    Items go to the texts in blocks of about ``block``; texts don't move, and their cost is linear in their length. Items without words stand in no text.
    """
    known = cut(windows.hashed(items, item_key, item_text, anchor))
    return windows.standing(texts, key, text, known, item_key, block).distinct()

