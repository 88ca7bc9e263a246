"""The stage loop and the life of batches against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import batches, cutting, staging

def accept():
    return F.col("response").startswith("ok")


def rows_of(spark, n=40):
    return spark.range(n).select("id", F.lit("own").alias("response"), F.when(F.col("id") % 2 == 0, "length").otherwise("stop").alias("finish_reason"), (F.col("id") % 5).alias("need"))


def effect(calls, name, test):
    def call(asked, budget):
        calls.append((name, budget, sorted(r.id for r in asked.select("id").collect())))
        return asked.filter("id % 7 <> 6").select("id", F.when(test(budget), F.concat(F.lit(f"ok {name} "), "id")).alias("response"), F.when(test(budget), "stop").otherwise("length").alias("finish_reason"))

    return call


def stages(calls):
    return [
        staging.Stage("first", effect(calls, "first", lambda b: F.col("id") % 4 == 1)),
        staging.Stage("longer", effect(calls, "longer", lambda b: F.col("need") * 100 < b), 100, 400, F.col("id") < 30),
        staging.Stage("last", effect(calls, "last", lambda b: F.col("id") % 3 == 0), 9),
    ]


def plain(n=40):
    """The same by loops: calls, and each row's response, stage, budget and attempts."""
    left, finish, out, calls, attempts = list(range(n)), {i: "length" if i % 2 == 0 else "stop" for i in range(n)}, {}, [], dict.fromkeys(range(n), 0)
    for name, budget, only in [("first", 0, None), *(("longer", b, 30) for b in (100, 200, 400)), ("last", 9, None)]:
        asked = [i for i in left if (only is None or i < only) and (name != "longer" or finish[i] == "length")]
        if asked:
            calls.append((name, budget, asked))
        for i in asked:
            if i % 7 != 6:
                attempts[i] += 1
                ok = {"first": i % 4 == 1, "longer": (i % 5) * 100 < budget, "last": i % 3 == 0}[name]
                finish[i] = "stop" if ok else "length"
                if ok:
                    out[i] = (f"ok {name} {i}", name, budget)
                    left.remove(i)
    return calls, {i: (*out.get(i, ("own", "none", None)), attempts[i]) for i in range(n)}


def test_stages_are_called_for_what_is_left(spark):
    calls = []
    got = staging.run(rows_of(spark), stages(calls), accept())
    want, rows = plain()
    assert calls == want
    assert {r.id: (r.response, r.stage, r.budget, r.attempts) for r in got.rows.collect()} == rows
    assert [(r.asked, r.left) for r in got.counts.orderBy("step").collect()][0] == (40, 40 - sum(i % 4 == 1 and i % 7 != 6 for i in range(40)))
    assert got.attempts.count() == sum(r[3] for r in rows.values()) and "need" in got.rows.columns


def test_a_run_that_goes_on_calls_nothing_twice(spark, tmp_path):
    calls, again = [], []
    broken = stages(calls)
    fails = lambda asked, budget: (_ for _ in ()).throw(RuntimeError("down"))
    with pytest.raises(RuntimeError):
        staging.run(rows_of(spark), [*broken[:2], staging.Stage("last", fails, 9)], accept(), folder=str(tmp_path))
    got = staging.run(rows_of(spark), stages(again), accept(), folder=str(tmp_path))
    assert [c[0] for c in calls] == ["first", "longer", "longer", "longer"] and [c[0] for c in again] == ["last"]
    assert {r.id: (r.response, r.stage, r.budget, r.attempts) for r in got.rows.collect()} == plain()[1]


def test_nothing_to_do(spark):
    calls = []
    got = staging.run(rows_of(spark).filter("id < 0"), stages(calls), accept())
    assert got.rows.count() == got.attempts.count() == 0 and calls == [] and {r.asked for r in got.counts.collect()} == {0}


def fold(reports):
    order = {s: i for i, s in enumerate(batches.STATES)}
    state, changes = "prepared", 0
    for r in reports:
        if r in order and state not in batches.TERMINAL and order[r] > order[state] and not (r in batches.TERMINAL and state == "prepared"):
            state, changes = r, changes + 1
    return state, len(reports), changes


def test_maps_compose_like_reports():
    rng = random.Random(1)
    table = batches.transitions()
    for _ in range(50):
        runs = sorted(rng.choices(range(4), k=rng.randint(1, 40)))
        codes = [rng.randrange(-1, len(batches.STATES)) for _ in runs]
        maps = table[codes]
        m, c, r = batches.composed(maps, (maps != np.arange(len(batches.STATES))).astype(np.int64), np.array(runs))
        assert r.tolist() == sorted(set(runs))
        for j, run in enumerate(r):
            own = [batches.STATES[x] if x >= 0 else "?" for x, y in zip(codes, runs) if y == run]
            assert (batches.STATES[m[j][0]], len(own), c[j][0]) == fold(own)


def test_a_log_is_folded_whole(spark):
    """One batch has most of the reports and goes over many tasks; some keys are null; reports come late, twice and unknown."""
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 30 + [None, "a", "b", "c", "d"]), rng.choice([None, *range(9)]), i, rng.choice([*batches.STATES[:5], *batches.STATES[:3], "Cancelling", "what", None] + (["failed", "completed"] if i > 350 else []))) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = batches.folded(spark.createDataFrame(rows, "k string, t int, i int, report string").repartition(7), ["k", "t"], ["i"]).collect()
        whole = batches.folded(spark.createDataFrame(rows, "k string, t int, i int, report string"), ["k"], ["i"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by, one = {}, {}
    for k, t, _, r in rows:
        by.setdefault((k, t), []).append((r or "").lower())
        one.setdefault(k, []).append((r or "").lower())
    assert {(r.k, r.t): (r.state, r.reports, r.changes) for r in got} == {k: fold(v) for k, v in by.items()}
    assert {r.k: (r.state, r.reports, r.changes) for r in whole} == {k: fold(v) for k, v in one.items()}
    assert batches.folded(spark.createDataFrame(rows, "k string, t int, i int, report string").filter("i < 0"), ["k"], ["i"]).count() == 0


class Fake:
    """Batches end after some polls; a request succeeds at its nth attempt. ``down`` after so many calls."""

    def __init__(self, down=None):
        self.submitted, self.polls, self.calls, self.down = [], {}, 0, down

    def called(self):
        self.calls += 1
        if self.down is not None and self.calls > self.down:
            raise ConnectionError

    def submit(self, name, requests):
        self.called()
        self.submitted.append((name, requests.count()))

    def status(self, name):
        self.called()
        self.polls[name] = self.polls.get(name, 0) + 1
        return ["validating", "in_progress", "in_progress", "completed" if hash(name) else "failed"][min(3, self.polls[name])]

    def results(self, name, requests):
        attempt = int(name[1 : name.index("-")])
        got = requests.filter("n % 9 <> 8")  # some are never seen
        content = F.when(F.col("n") % 4 <= attempt, F.concat(F.lit("good "), "custom_id")).otherwise("bad")
        return got.select("custom_id", content.alias("content"), F.when((F.col("n") % 5 == 4) & (F.lit(attempt) < 1), "500").alias("error")).unionByName(requests.sparkSession.createDataFrame([("stranger", "good", None)], "custom_id string, content string, error string"))


def tasks_of(spark):
    return spark.range(60).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("custom_id"), F.col("id").alias("n"))


def settled(n):
    """At which attempt a request succeeds, of three."""
    return next((a for a in range(3) if n % 9 != 8 and n % 4 <= a and not (n % 5 == 4 and a < 1)), None)


def test_a_batch_run_from_submit_to_retries(spark, tmp_path):
    done, failed = batches.run(tasks_of(spark), client := Fake(), str(tmp_path), 25, F.col("content").startswith("good"), retries=2)
    assert {r.custom_id: (r.content, r.attempts) for r in done.collect()} == {f"r{n}": (f"good r{n}", settled(n) + 1) for n in range(60) if settled(n) is not None}
    assert {r.custom_id for r in failed.collect()} == {f"r{n}" for n in range(60) if settled(n) is None}
    assert {r.error for r in failed.collect()} == {"missing from the batch's results", "invalid"}
    assert sum(n for name, n in client.submitted if name.startswith("a0")) == 60


def test_a_batch_run_that_stops_goes_on(spark, tmp_path):
    kept, valid = [], F.col("content").startswith("good")
    for down in (1, 4, 9, None):  # the process dies three times
        client = Fake(down)
        try:
            done, failed = batches.run(tasks_of(spark), client, str(tmp_path), 25, valid, retries=2)
        except ConnectionError:
            pass
        kept += [name for name, _ in client.submitted]
    assert len(kept) == len(set(kept))  # nothing is submitted twice
    assert {r.custom_id: r.attempts for r in done.collect()} == {f"r{n}": settled(n) + 1 for n in range(60) if settled(n) is not None}
    with pytest.raises(batches.TimedOut):
        batches.run(tasks_of(spark), Fake(), str(tmp_path / "other"), 25, valid, polls=1)


def test_what_is_left_is_shuffled(spark, monkeypatch):
    """Keys and flags are a byte a row in a cut table's files; by their size Spark broadcast millions of rows through the driver."""
    plans = []
    seen = lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or cutting.cut(rows)
    monkeypatch.setattr(staging, "cut", seen)
    rows = spark.range(1_000).select("id", F.lit("cut").alias("response"), F.lit("length").alias("finish_reason"))
    effect = lambda asked, budget: asked.filter(f"id % 4 < {budget}").select("id", F.lit("ok").alias("response"), F.lit("length").alias("finish_reason"))
    out = staging.run(rows, [staging.Stage("one", effect, 1), staging.Stage("two", effect, 2)], F.col("response") == "ok")
    plans.append(out.rows._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) >= 5 and not any("Broadcast" in p for p in plans)
    assert [r["left"] for r in out.counts.orderBy("step").collect()] == [750, 500]
