"""The life of batches of requests: an append-only log of what was reported, folded by a table of transitions; submit, poll, collect, retry on top of it.

A report moves a batch forward or does nothing: a status behind the one that is known is late or repeated, and after a terminal one nothing counts. As each report is
a map from states to states, and maps compose, a log is folded piece by piece: rows are dealt by range of batch and time, each task composes each batch's
run into one map, and what meets at the end is at most a map a task for each batch, however many reports one batch has.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import ledgers
from .cutting import kept

#: Statuses in the order of a batch's life; the last four are terminal. "prepared" is before any report.
STATES = ("prepared", "submitted", "validating", "in_progress", "finalizing", "cancelling", "completed", "failed", "expired", "cancelled")
TERMINAL = STATES[6:]


def transitions() -> np.ndarray:
    """For each report, and last for one that isn't known, the state that follows each state."""
    n = len(STATES)
    table = np.tile(np.arange(n, dtype=np.uint8), (n + 1, 1))
    for report in range(n):
        ahead = np.arange(n) < report
        ahead[[STATES.index(t) for t in TERMINAL]] = False
        if STATES[report] in TERMINAL:
            ahead[0] = False  # nothing that wasn't submitted ends
        table[report, ahead] = report
    return table


def composed(maps: np.ndarray, changes: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of neighbouring equal ``run`` as one map each, with how many changes it makes from each state; pairs of neighbours at a time."""
    while len(run) > 1 and (run[1:] == run[:-1]).any():
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        place = np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))
        left = np.flatnonzero(place % 2 == 0)
        paired = left[(left + 1 < len(run)) & (run[np.minimum(left + 1, len(run) - 1)] == run[left])]
        maps, changes = maps.copy(), changes.copy()
        after = maps[paired]
        changes[paired] += np.take_along_axis(changes[paired + 1], after.astype(np.int64), 1)
        maps[paired] = np.take_along_axis(maps[paired + 1], after.astype(np.int64), 1)
        maps, changes, run = maps[left], changes[left], run[left]
    return maps, changes, run


def folded(log: DataFrame, keys: list[str], at: list[str], report: Column | str = "report") -> DataFrame:
    """keys, state, reports (how many there are), changes (how many did anything) of a log in the order of ``at``; null keys are a batch too."""
    report = F.col(report) if isinstance(report, str) else report
    code = F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), F.lower(report)), F.lit(0)) - 1
    own = [f"k{i}" for i in range(len(keys))]
    rows = log.select(*(F.col(k).alias(x) for k, x in zip(keys, own, strict=True)), *(F.col(a).alias(f"a{i}") for i, a in enumerate(at)), code.cast("int").alias("report"))
    order = [*own, *(f"a{i}" for i in range(len(at))), "report"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*own, "report")
    kinds = T.StructType([*ordered.schema.fields[: len(own)], T.StructField("piece", T.LongType()), T.StructField("map", T.ArrayType(T.IntegerType())), T.StructField("changes", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())])
    table = transitions()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held, number = to_arrow_schema(kinds), None, TaskContext.get().partitionId() << 32

        def made(groups: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            columns = [[g[0][i] for g in groups] for i in range(len(own))]
            columns += [list(range(number, number + len(groups))), [g[1].tolist() for g in groups], [g[2].tolist() for g in groups], [g[3] for g in groups]]
            number += len(groups)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for b in batches:
            if not b.num_rows:
                continue
            keyed = list(zip(*(b.column(i).to_pylist() for i in range(len(own))), strict=True))
            run = np.cumsum(np.array([True, *(x != y for x, y in zip(keyed[1:], keyed))]))
            codes = b.column("report").to_numpy()
            maps = table[codes]
            m, c, r = composed(maps, (maps != np.arange(len(STATES))).astype(np.int64), run)
            first = np.searchsorted(run, r)
            groups = [(keyed[i], m[j], c[j], int(n)) for j, (i, n) in enumerate(zip(first, np.diff(np.append(first, len(run))), strict=True))]
            if held and held[0] == groups[0][0]:  # a batch of reports that goes on from the last Arrow batch
                k, m0, c0, n0 = held
                _, m1, c1, n1 = groups[0]
                groups[0] = (k, m1[m0], c0 + c1[m0], n0 + n1)
            elif held:
                yield made([held])
            held = groups.pop()
            if groups:
                yield made(groups)
        if held:
            yield made([held])

    some = ordered.mapInArrow(pieces, kinds).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("piece", "map", "changes"))).alias("p"), F.sum("n").alias("reports"))  # at most a piece a task
    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("c"))
    end = F.aggregate("p", start, lambda a, x: F.struct(F.element_at(x["map"], a["s"] + 1).alias("s"), (a["c"] + F.element_at(x["changes"], a["s"] + 1)).alias("c")))
    done = some.withColumn("e", end)
    return done.select(*(F.col(x).alias(k) for k, x in zip(keys, own, strict=True)), F.element_at(F.array(*map(F.lit, STATES)), F.col("e.s") + 1).alias("state"), "reports", F.col("e.c").alias("changes"))


class Client(Protocol):
    """Who runs batches. ``submit`` and ``status`` speak of one batch by its name; ``results`` gives custom_id, content and error for what has ended."""

    def submit(self, name: str, requests: DataFrame) -> None: ...

    def status(self, name: str) -> str: ...

    def results(self, name: str, requests: DataFrame) -> DataFrame: ...


class TimedOut(RuntimeError):
    """Batches that didn't end within the polls allowed."""


def run(tasks: DataFrame, client: Client, path: str, size: int, valid: Column, retries: int = 3, polls: int = 1_000, pause=lambda poll: None) -> tuple[DataFrame, DataFrame]:
    """Tasks (custom_id and what a request needs) through batches of about ``size``; results that are ``valid`` (over content), and what failed with its last error.

    The folder holds each attempt's requests, the log of reports and the results. A run over a folder in which another stopped goes on where that one did: what the log says was
    submitted isn't submitted again, and attempts whose results are written aren't asked for. Failed, unseen and invalid requests are tried again, ``retries`` times.
    """
    spark = tasks.sparkSession
    log = f"{path}/log"
    report = lambda name, status: ledgers.append(spark.createDataFrame([(name, status)], "name string, report string"), log, f"{name}-{status}", files=1)
    known = lambda: {e["batch"] for e in ledgers.entries(spark, log)}
    left, done, errors = tasks, [], None
    for attempt in range(1 + retries):
        requests = kept(lambda left=left: left.withColumn("batch", F.pmod(F.xxhash64("custom_id"), F.lit(max(1, -(-left.count() // size))))), f"{path}/requests/attempt={attempt}", spark)
        names = {r[0]: f"a{attempt}-b{r[0]}" for r in requests.select("batch").distinct().collect()}  # a batch has ``size`` requests, so these are few
        if not names:
            break
        said = known()
        for number, name in names.items():
            if f"{name}-submitted" not in said:
                client.submit(name, requests.filter(F.col("batch") == number).drop("batch"))
                report(name, "submitted")
        open_ = {n for n in names.values() if not any(f"{n}-{t}" in said for t in TERMINAL)}
        for poll in range(polls):
            for name in sorted(open_):
                report(name, status := client.status(name))
                if status in TERMINAL:
                    open_.discard(name)
            if not open_:
                break
            pause(poll)
        else:
            raise TimedOut(", ".join(sorted(open_)))

        def collected(requests=requests, names=names) -> DataFrame:
            got = None
            for number, name in names.items():
                asked = requests.filter(F.col("batch") == number)
                some = client.results(name, asked).select("custom_id", "content", "error")
                got = some if got is None else got.unionByName(some)
            # Of several results for one request a valid one counts; results that nobody asked for fall away.
            one = got.withColumn("ok", F.coalesce(valid & F.col("error").isNull(), F.lit(False))).groupBy("custom_id").agg(F.max_by(F.struct("content", "error", "ok"), F.struct("ok", "content")).alias("r"))
            joined = requests.drop("batch").join(one, "custom_id", "left")
            error = F.when(F.col("r").isNull(), "missing from the batch's results").when(~F.col("r.ok"), F.coalesce("r.error", F.lit("invalid")))
            return joined.withColumns({"content": F.col("r.content"), "error": error}).drop("r")

        results = kept(collected, f"{path}/results/attempt={attempt}", spark)
        done.append(results.filter("error IS NULL").drop("error").withColumn("attempts", F.lit(attempt + 1)))
        failed = results.filter("error IS NOT NULL")
        left, errors = failed.drop("content", "error"), failed.select("custom_id", "error")
        if left.isEmpty():
            break
    none = tasks.filter("false")
    whole = none.withColumns({"content": F.lit(None).cast("string"), "attempts": F.lit(0)})
    for d in done:
        whole = whole.unionByName(d)
    return whole, errors if errors is not None else none.select("custom_id", F.lit("").alias("error"))
