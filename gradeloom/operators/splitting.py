"""Deterministic samples, quotas and splits. The order of rows is md5 of a seed and the id, the same in any engine and on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cutting import cut


def shuffle_key(seed: int | str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def sampled(rows: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """``count`` rows; an error if there are fewer. A top-k, so no task sorts all rows."""
    out = rows.orderBy(shuffle_key(seed, key), key).limit(count)
    if (n := out.count()) < count:
        raise ValueError(f"{count} rows wanted, {n} there")
    return out


#: Rows up to which a window may order them in a task a group.
ONE_TASK = 500_000


def running(rows: DataFrame, by: list[str], order: list[str], amount: Column | None = None, name: str = "before") -> DataFrame:
    """``rows`` with the sum of ``amount`` (1, if not given) of the rows before each one in its group (columns ``by``; none: all rows), by ``order``, which has no ties.

    Rows are dealt by ranges of group and order and written so; each range's total gives the next one its start, and a second pass its rows. A
    hot group fills as many ranges as it needs, so no task holds it. Tables of few rows are ordered in a window a group.
    """
    keyed = rows.withColumn("__amount", F.lit(1).cast("long") if amount is None else amount)
    before = lambda w: F.coalesce(F.sum("__amount").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if rows.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return keyed.withColumn(name, before(Window.partitionBy(*by).orderBy(*order)).cast("long")).drop("__amount")
    ranged = cut(keyed.repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()))
    totals = ranged.groupBy("__p").agg(F.sum("__amount").alias("__n"))
    starts = totals.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # one row a range
    placed = ranged.join(F.broadcast(starts), F.col("__p") == F.col("__q")).withColumn(name, (F.col("__start") + before(Window.partitionBy("__p").orderBy(*by, *order))).cast("long"))
    placed = placed.drop("__p", "__q", "__start", "__amount")
    if not by:
        return placed
    placed = cut(placed)
    first = placed.groupBy(*by).agg(F.min(name).alias("__first")).select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(by)), "__first")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return placed.join(first, same).withColumn(name, F.col(name) - F.col("__first")).drop("__first", *(f"__g{i}" for i in range(len(by))))


def numbered(rows: DataFrame, stratum: list[str], key: str, seed: int, name: str = "position") -> DataFrame:
    """Each row's place, from 1, in its stratum's order; strata may hold any share of the rows."""
    ordered = running(rows.withColumn("__o", shuffle_key(seed, key)), stratum, ["__o", key], name=name)
    return ordered.withColumn(name, F.col(name) + 1).drop("__o")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """``by`` and ``quantiles``: for each share the value at that share of a group's order, between two values in proportion. Exact, over counts of distinct values."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    counts = cut(counts)
    groups = counts.groupBy(*by).agg(F.sum("__n").alias("__all")) if by else counts.agg(F.sum("__n").alias("__all"))
    placed = running(counts, by, [value], F.col("__n"), "__before")
    at = [F.lit(float(p)) * (F.col("__all") - 1) for p in shares]
    names = [(f"__{end}{i}", f(x)) for i, x in enumerate(at) for end, f in (("low", F.floor), ("high", F.ceil))]
    if by:
        other = groups.select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(by)), "__all")
        same = F.lit(True)
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
        placed = placed.join(other, same)
    else:
        placed = placed.join(F.broadcast(groups))  # one row is broadcast
    held = lambda rank: F.max(F.when((F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n")), F.col(value).cast("double")))
    found = placed.groupBy(*by).agg(F.max("__all").alias("__all"), *(held(rank).alias(name) for name, rank in names))
    between = [F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * (x - F.floor(x)) for i, x in enumerate(at)]
    return found.select(*by, F.array(*between).alias("quantiles"))


def quotas(rows: DataFrame, stratum: list[str], size: int) -> DataFrame:
    """Rows to take of each stratum by largest remainder: the floor of its share, then one more by falling remainder, then stratum, until ``size``.

    Works on one row a stratum.
    """
    counts = rows.groupBy(*stratum).agg(F.count("*").alias("available"))
    total = counts.agg(F.coalesce(F.sum("available"), F.lit(0))).first()[0]
    if size > total:
        raise ValueError(f"{size} rows wanted, {total} there")
    raw = F.lit(size).cast("double") * F.col("available") / F.lit(max(total, 1)).cast("double")
    base = counts.withColumns({"raw": raw, "base": F.least(F.floor(raw), F.col("available"))})
    left = size - (base.agg(F.coalesce(F.sum("base"), F.lit(0))).first()[0])
    open_ = F.col("base") < F.col("available")
    order = Window.orderBy(open_.desc(), (F.col("raw") - F.floor("raw")).desc(), *(F.col(s).desc() for s in stratum))  # one row a stratum
    return base.withColumn("__r", F.row_number().over(order)).withColumn("quota", (F.col("base") + F.when(open_ & (F.col("__r") <= left), 1).otherwise(0)).cast("long")).select(*stratum, "available", "quota")


def stratified(rows: DataFrame, stratum: list[str], key: str, size: int, seed: int) -> DataFrame:
    """``size`` rows with each stratum's quota."""
    need = quotas(rows, stratum, size).select(*stratum, "quota")
    return numbered(rows, stratum, key, seed).join(need, stratum).filter("position <= quota").drop("position", "quota")


def split3(rows: DataFrame, stratum: list[str], key: str, seed: int, train: float = 0.7, dev: float = 0.15) -> DataFrame:
    """``split``: train, dev or holdout; each stratum gives the whole part of its share, the rest to holdout."""
    n = rows.groupBy(*stratum).agg(F.count("*").alias("__n"))
    a, b = (F.floor(F.lit(x).cast("double") * F.col("__n")) for x in (train, dev))
    part = F.when(F.col("position") <= a, "train").when(F.col("position") <= a + b, "dev").otherwise("holdout")
    return numbered(rows, stratum, key, seed).join(n, stratum).withColumn("split", part).drop("__n", "position")


def ranges(rows: DataFrame, key: str, seed: int, **sizes: int) -> DataFrame:
    """``split`` by consecutive ranges of one shuffled order, e.g. dev=1000, holdout=1000; the rest is train.

    The borders are two order keys found by top-k, so rows are compared with constants and never sorted as a whole.
    """
    order = F.concat(shuffle_key(seed, key), F.lit(":"), F.lpad(F.col(key).cast("string"), 20, "0"))
    total, split = 0, None
    for name, size in sizes.items():
        total += size
        cut = rows.select(order.alias("o")).orderBy("o").limit(total).agg(F.max("o"), F.count("*")).first()
        if cut[1] < total:
            raise ValueError(f"{total} rows wanted, {cut[1]} there")
        split = F.when(order <= cut[0], name) if split is None else split.when(order <= cut[0], name)
    return rows.withColumn("split", split.otherwise("train"))


def disjoint(rows: DataFrame, key: str, part: str) -> DataFrame:
    """Keys in more than one part: none, if the parts are disjoint."""
    return rows.groupBy(key).agg(F.count_distinct(part).alias("parts")).filter("parts > 1")


def by_source(rows: DataFrame, source: str, key: str, quota: dict[str, int], seed: int) -> DataFrame:
    """So many rows of each source."""
    need = rows.sparkSession.createDataFrame(list(quota.items()), f"{source} string, __quota long")
    return numbered(rows, [source], key, seed).join(F.broadcast(need), source).filter("position <= __quota").drop("__quota", "position")  # a row a source named


def part_numbers(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``part``: consecutive parts of ``size`` rows in the order of a unique key, however its values lie."""
    return running(rows, [], [key], name="part").withColumn("part", F.floor(F.col("part") / size).cast("long"))


def first_rows(rows: DataFrame, order: list[str], key: str, count: int, seed: int) -> DataFrame:
    """The first ``count`` rows in an order without ties, with their ``position``, from 1, in a shuffled one. Errors if there are fewer."""
    out = rows.orderBy(*order).limit(count)
    if (n := out.count()) < count:
        raise ValueError(f"{count} rows wanted, {n} there")
    return numbered(out, [], key, seed)


def systematic(values: Column, step: Column, count: int) -> Column:
    """Every ``step``-th element of an array from the first on, at most ``count``."""
    return F.slice(F.filter(values, lambda x, i: i % step == 0), F.lit(1), F.lit(count))
