"""Retry loops, style and diagnosis on small tables."""

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import corpus as C
from gradeloom.functions import style as S
from gradeloom.operators import diagnosing as D
from gradeloom.operators import repairing, working


def test_attempts_shrink(spark, tmp_path):
    tasks = spark.createDataFrame([(i,) for i in range(5)], "id long")
    replies = spark.createDataFrame([(1, 0, "ok"), (2, 0, "bad"), (2, 1, "ok"), (3, 3, "ok"), (4, 0, "bad")], "id long, attempt int, text string")
    done = spark.createDataFrame([(0,)], "id long")
    for folder in (str(tmp_path / "w"), None):
        out, failed = working.attempted(tasks, done, working.replayed(replies), F.col("text") == "ok", retries=3, folder=folder)
        assert sorted((r.id, r.attempts) for r in out.collect()) == [(1, 1), (2, 2), (3, 4)]
        assert [r.id for r in failed.collect()] == [4]
    out, failed = working.attempted(tasks, tasks, working.replayed(replies), F.col("text") == "ok")
    assert out.count() == 0 and failed.count() == 0
    assert [working.pause(i) for i in range(6)] == [0, 2, 5, 10, 10, 10]


def test_queues_and_states(spark):
    tasks = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    outputs = spark.createDataFrame([(1, True), (2, False)], "id long, ok boolean")
    assert {(r.id, r.reason) for r in working.retry_queue(tasks, outputs, ~F.col("ok")).collect()} == {(2, "invalid"), (3, "missing")}
    log = spark.createDataFrame([(1, 0, "failed"), (1, 1, "done"), (2, 0, "failed")], "id long, attempt int, state string")
    assert {(r.id, r.state) for r in working.latest_states(log).collect()} == {(1, "done"), (2, "failed")}


def test_batches(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "custom_id string")
    body = '{"response": {"status_code": %d, "body": {"choices": [{"message": {"content": "x"}}]}}}'
    got = spark.createDataFrame([("a", body % 200), ("b", body % 500), ("z", body % 200)], "custom_id string, body string")
    assert {(r.custom_id, r.state) for r in repairing.collected(asked, got).collect()} == {("a", "done"), ("b", "failed"), ("c", "unseen"), ("z", "unknown")}


@pytest.mark.parametrize("answer, question, styled", [("7(x+2)(x-3)", "", "7*(x+2)*(x-3)"), ("\\frac{\\sqrt{3}}{2}", "", "sqrt(3)/2"), ("cos\\theta+1", "Enter t for the variable theta", "cos(t)+1"), ("YES, no", "Answer yes or no", "Yes,No"), ("ln p + 2", "", "ln(p)+2"), ("Tommy", "", "Tommy"), ("2^{10}", "", "2**(10)"), ("1e-5+x", "", "1e-5+x")])
def test_styles(spark, answer, question, styled):
    assert spark.range(1).select(S.expression_style(F.lit(answer), F.lit(question))).first()[0] == styled


def test_stable_answers(spark):
    rows = spark.createDataFrame([(a,) for a in ("12", "\\sqrt{2}", "x+1", "3 cm", "five", "1,2", "x=2", "sin(x)")], "a string")
    assert [r[0] for r in rows.select(C.stable(F.col("a"))).collect()] == [True, False, True, False, False, False, False, True]


def test_wrong_answers(spark):
    rows = spark.createDataFrame([(["3"], ["3.001"]), (["3"], ["4"]), (["a", "b"], ["A", "b"]), ([""], [])], "g array<string>, f array<string>")
    got = [r[0] for r in rows.select(D.wrong_answer(F.lit("stop"), F.lit(False), F.col("g"), F.col("f"))).collect()]
    assert got == ["rounding", "real-error", "notation", "empty-extracted"]


def test_attempts_that_are_written_are_not_made_again(spark, tmp_path):
    calls = []

    def effect(tasks, attempt):
        calls.append((attempt, tasks.count()))
        return tasks.withColumn("answer", F.col("id") % 3 == attempt)

    tasks, none = spark.range(9), spark.range(0)
    first = working.attempted(tasks, none, effect, F.col("answer"), folder=str(tmp_path / "a"), retries=1)
    again = working.attempted(tasks, none, effect, F.col("answer"), folder=str(tmp_path / "a"), retries=2)
    assert calls == [(0, 9), (1, 6), (2, 3)]  # the second run made only what the first hadn't
    assert (first[0].count(), first[1].count(), again[0].count(), again[1].count()) == (6, 3, 9, 0)
