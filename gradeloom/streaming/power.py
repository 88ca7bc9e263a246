"""Energy of sensor series as they come: the intervals of ``energy.intervals``, and of counters that wrap, across micro-batches.

Each series keeps two things: the last sample that was settled, and samples that may still be overtaken. A sample is settled once the watermark has passed it: a timer
for the earliest open one wakes the series, which puts what the watermark has passed in order and gives an interval for each. So results don't depend on how rows
fall into batches. State of a series is one sample and those within the allowed lateness.

Rows older than the watermark when they come are late: Spark leaves them out, and counts them in the query's progress. Samples of one time are ordered by ``order``; repeated rows
are samples of their own, zero seconds apart. A missing watt counts as in ``energy.intervals``; a counter that falls has wrapped at ``limit``, as in ``energy.counter_delta``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SAMPLE = T.StructType([T.StructField(c, k) for c, k in (("t", T.LongType()), ("o", T.LongType()), ("watts", T.DoubleType()), ("counter", T.DoubleType()))])
INTERVAL = T.StructType([T.StructField(c, k) for c, k in (("series", T.StringType()), ("t", T.LongType()), ("o", T.LongType()), ("seconds", T.DoubleType()), ("joules", T.DoubleType()), ("counted", T.DoubleType()))])


def interval(a: tuple, b: tuple, limit: float) -> tuple[float, float | None, float | None]:
    """Seconds, joules by the trapezoid, and the counter's growth from sample a to sample b (t in microseconds, order, watts, counter)."""
    known = lambda x: x is not None and x == x
    seconds = max(0.0, (b[0] - a[0]) / 1e6)
    watts = [x for x in (a[2], b[2]) if known(x)]
    joules = None if not watts else (watts[0] + watts[-1]) / 2 * seconds
    grown = None
    if known(a[3]) and known(b[3]):
        grown = b[3] - a[3] if b[3] >= a[3] else limit - a[3] + b[3] if limit > 0 else None
    return seconds, joules, grown if grown is not None and 0 < grown < float("inf") else None


class Series(StatefulProcessor):
    def __init__(self, limit: float) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", SAMPLE)
        self.open = handle.getListState("open", SAMPLE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(o), w, c) for part in rows for t, o, w, c in zip(part["t"], part["o"], part["watts"], part["counter"], strict=True)]
        if new:
            self.open.appendList(new)
            self.wake(min(t for t, *_ in new))
        return iter(())  # intervals come by timers; an empty frame a series and batch would cost more than its samples

    def wake(self, earliest: int) -> None:
        """A timer for the first millisecond that is over once the watermark is past the earliest open sample."""
        self.handle.registerTimer(earliest // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(((int(r[0]), int(r[1]), r[2], r[3]) for r in self.open.get()), key=lambda r: r[:2])
        settled = [r for r in held if r[0] // 1000 < mark]
        left = held[len(settled) :]
        before, out = self.last.get(), []  # None for a series' first; each call of a state is a round trip
        for now in settled:
            if before is not None:
                out.append((key[0], now[0], now[1], *interval(before, now, self.limit)))
            before = now
        if settled:
            self.last.update(before)
            if left:
                self.open.put(left)
            else:
                self.open.clear()
        if left:
            self.wake(left[0][0])
        if out:
            yield pd.DataFrame(out, columns=INTERVAL.names).astype({"seconds": float, "joules": float, "counted": float})

    def close(self) -> None:
        pass


def intervals(samples: DataFrame, series: str, at: str, watts: str, order: str, late: str, counter: str | None = None, limit: float = 0.0) -> DataFrame:
    """series (as text), t (microseconds) and o of each sample but a series' first, with seconds, joules and the counter's growth since the one before. A stream; start it with ``started``."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    rows = samples.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    rows = rows.select("__at", F.col(series).cast("string").alias("series"), t.alias("t"), F.col(order).cast("long").alias("o"), F.col(watts).cast("double").alias("watts"), (F.col(counter).cast("double") if counter else F.lit(None).cast("double")).alias("counter"))
    return rows.filter("t IS NOT NULL").groupBy("series").transformWithStateInPandas(Series(limit), INTERVAL, "Append", "EventTime")


def started(out: DataFrame, target: str, checkpoint: str):
    """The stream's intervals appended to Parquet files, each once, until nothing new is left; returns the query."""
    spark = out.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        return out.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
