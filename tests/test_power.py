"""Energy over a stream against energy over a table."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import energy
from gradeloom.streaming import power

KINDS = "device long, at timestamp, n long, watts double, joules double"
FAR = 10_000_000


def samples(rng, n):
    """Samples of a few devices over some hours, with ties, repeated rows, missing watts and counters that wrap at 500."""
    out = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 7_200), i, rng.choice([None, 5.0, rng.random() * 99]), float(rng.randint(0, 499))) for i in range(n)]
    return sorted(out + out[:5], key=lambda r: r[1])


def frame(spark, rows):
    return spark.createDataFrame(rows, "device long, s long, n long, watts double, joules double").select("device", F.timestamp_seconds(F.col("s") + 86_400).alias("at"), "n", "watts", "joules")


def run(spark, tmp_path, batches, late):
    """Each batch is a file that comes after the one before; a last row far ahead settles all that is open."""
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in [*batches, [(-1, FAR, 0, 1.0, 1.0)]]:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(KINDS).parquet(folder)
        out = power.intervals(stream, "device", "at", "watts", "n", late, "joules", 500.0)
        query = power.started(out, target, str(tmp_path / "state"))
        query.awaitTermination(180)
        assert query.exception() is None
    return spark.read.schema(power.INTERVAL).parquet(target).filter("series <> '-1'"), query


def test_a_stream_in_batches_equals_the_table(spark, tmp_path):
    rng = random.Random(3)
    rows = samples(rng, 160)
    batches = [[], [], []]
    for r in rows:  # up to ten minutes out of order
        batches[min(2, max(0, (r[1] + rng.randint(-300, 300)) // 2_400))].append(r)
    got, _ = run(spark, tmp_path, batches, "20 minutes")
    table = energy.intervals(frame(spark, rows), ["device"], "at", "watts", ["n"])
    want = {}
    for r in table.collect():
        want.setdefault(r.device, []).append((r.seconds, r.joules))
    found = {}
    for r in got.orderBy("series", "t", "o").collect():
        found.setdefault(int(r.series), []).append((r.seconds, r.joules))
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in want.items()}
    total = lambda v: (sum(s for s, _ in v), sum(j for _, j in v if j is not None and not math.isnan(j)))
    for k, v in want.items():
        assert total(found[k]) == pytest.approx(total(v))
    counted = energy.counter_delta(F.lag("joules").over(energy.Window.partitionBy("device").orderBy("at", "n")), F.col("joules"), F.lit(500.0))
    grown = {r[0]: r[1] for r in frame(spark, rows).withColumn("d", counted).groupBy("device").agg(F.sum("d")).collect()}
    assert {int(r[0]): r[1] for r in got.groupBy("series").agg(F.sum("counted")).collect()} == pytest.approx(grown)


def test_late_rows_are_left_out(spark, tmp_path):
    early = [(1, s, s, 10.0, 0.0) for s in range(0, 1_000, 100)]
    got, query = run(spark, tmp_path, [early, [(1, 5_000, 5_000, 10.0, 0.0)], [(1, 5_100, 5_100, 10.0, 0.0), (1, 250, 250, 99.0, 0.0)]], "1 minute")
    assert [r.t // 1_000_000 - 86_400 for r in got.orderBy("t").collect()] == [*range(100, 1_000, 100), 5_000, 5_100]
    assert got.agg(F.sum("joules")).first()[0] == pytest.approx(51_000)


def test_one_interval():
    assert power.interval((0, 0, 4.0, 490.0), (2_000_000, 1, 6.0, 10.0), 500.0) == (2.0, 10.0, 20.0)
    assert power.interval((5, 0, None, None), (5, 1, float("nan"), 3.0), 0.0) == (0.0, None, None)
    assert power.interval((0, 0, 4.0, 9.0), (1_000_000, 1, None, 3.0), 0.0) == (1.0, 4.0, None)
