"""Accounts of runs against plain counts."""

import random

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import answers as A
from gradeloom.operators import energy, grading, judging, reconciling, scoring


def test_states(spark):
    rng = random.Random(2)
    inputs = [rng.choice([None, *range(30)]) for _ in range(40)]
    outputs = [(rng.choice([None, *range(20, 45)] + [3] * 20), rng.choice(["", "", "", "bad"])) for _ in range(60)]
    failures = [rng.choice(range(15, 40)) for _ in range(15)]
    kinds = spark.createDataFrame([(i, "x") for i in inputs], "id int, state string"), spark.createDataFrame(outputs, "id int, e string"), spark.createDataFrame([(i,) for i in failures], "id int")
    got = reconciling.states(*kinds, "id", F.when(F.col("e") != "", F.array("e")).otherwise(F.array()))
    want = {}
    for i in {x for x in inputs if x is not None} | {o for o, _ in outputs}:
        own = [e for o, e in outputs if o == i]
        asked, failed = i in set(inputs) and i is not None, i in failures
        want[i] = ("orphan" if not asked else "invalid" if "bad" in own else "conflicting" if own and failed else "duplicate" if len(own) > 1 else "success" if own else "failed" if failed else "missing", len(own), "bad" if "bad" in own else None)
    assert {r.id: (r.state, r.outputs, r.error) for r in got.collect()} == want
    counts = reconciling.counts(got).first()
    assert counts.keys == len(want) and {s: counts[s] for s in reconciling.STATES} == {s: sum(w[0] == s for w in want.values()) for s in reconciling.STATES} and not counts.complete
    good = reconciling.states(spark.range(3), spark.range(2).withColumn("e", F.lit("")), spark.range(2, 3), "id", F.array())
    assert reconciling.counts(good).first().complete and reconciling.counts(good.filter("id > 9")).first().keys == 0


def test_format_measures(spark):
    rows = [("stop", False, None, 2, 2, "ab", "abc", None, True, False), ("length", False, None, 0, 1, None, "", True, None, None), (None, True, "", 0, 1, "x", "x", False, False, True), ("STOP", True, "B", None, 1, "xyz", None, None, None, None), ("", False, None, 3, 2, "", "", None, None, None)]
    kinds = "finish string, is_mcq boolean, letter string, items int, gold int, response string, raw string, fallback_used boolean, stage0_repair_used boolean, postprocess_used boolean"
    got = scoring.format_measures(spark.createDataFrame(rows, kinds)).first().asDict()
    assert got == {"truncation_count": 1, "no_extraction_count": 1, "count_mismatch_count": 1, "mcq_format_error_count": 1, "format_error_count": 3, "fallback_used": 1, "stage0_repair_used": 1, "postprocess_used": 1, "free_total": 3, "mcq_total": 2, "avg_response_chars": 1.2, "avg_raw_response_chars": 0.8}
    none = scoring.format_measures(spark.createDataFrame([], kinds)).first()
    assert none.free_total == 0 and none.avg_response_chars == 0.0


def test_summary(spark):
    rows = spark.createDataFrame([("a", 1, True, None), ("a", 1, None, "x"), ("a", 2, False, "y"), ("b", 1, True, "x")], "p string, c int, ok boolean, e string")
    got = {tuple(r[:2]): tuple(r[2:]) for r in scoring.summary(rows, ["p", "c"], F.col("ok"), "e", ["x", "y"]).collect()}
    assert got == {("a", 1): (2, 1, 0.5, 1, 0), ("a", 2): (1, 0, 0.0, 0, 1), ("b", 1): (1, 1, 1.0, 1, 0)}


def test_strata_and_rates(spark):
    rows = spark.createDataFrame([("x [ANS] [ANS]", None), ("[ANS]" * 9, ["a"]), ("In the Table", []), ("\\begin{array} [ANS]", ["a", "b"])], "q string, o array<string>")
    got = [tuple(r) for r in rows.select(grading.blanks_stratum(F.col("q")), grading.format_stratum(F.col("q"), F.col("o"))).collect()]
    assert got == [("2|normal", "free|2|normal"), ("8|table", "mcq|6|table"), ("0|table", "free|0|table"), ("1|table", "mcq|1|table")]
    one = spark.sql("SELECT TIMESTAMP '2024-07-03 17:00:00' AS middle, 3.6e6D AS joules")
    days = energy.holidays(spark, 2024, 2024)
    assert [round(energy.priced(one, days, **k).first().cost, 5) for k in ({}, {"credit": True}, {"flat": 0.2})] == [0.69572, 0.5868, 0.2]
    assert energy.priced(one, days, flat=0.2).first().period == "flat"


@pytest.mark.parametrize("text, framed, final", [("\\boxed{a} then \\fbox{b{c}}", "b{c}", None), ("\\fbox{a} and \\boxed{open", "a", None), ("so \\boxed{open to the end ", "open to the end", None), ("none", "", None), ("FINAL_ANSWERS: \\boxed{7}", "7", "7"), ("\\boxed{6} FINAL_ANSWERS \\boxed{7", "6", None), ("FINAL_ANSWERS \\boxed{1} FINAL_ANSWERS \\boxed{2} \\boxed{3}", "3", "3")])
def test_boxes_of_several_kinds(spark, text, framed, final):
    row = spark.createDataFrame([(text,)], "t string").select(A.last_framed(F.col("t")), A.answer_box(F.col("t"))).first()
    assert tuple(row) == (framed, final)


@pytest.mark.parametrize("text, options, letters", [("\\boxed{0.50}", ["1", "\\frac{1}{2}"], "B"), ("\\boxed{AB}", ["1", "2"], "AB"), ("\\boxed{AC}", ["1", "2"], ""), ("\\boxed{two}", ["one", " two "], "B"), ("\\boxed{x+1} option (A)", ["3", "1+x"], "B"), ("\\boxed{9} option (A)", ["3", "4"], "A"), ("I choose C", None, "C"), (None, ["1"], ""), ("\\boxed{} thus b", ["", "2"], "B")])
def test_letters_by_value(spark, text, options, letters):
    row = spark.createDataFrame([(text, options)], "t string, o array<string>").select(judging.letters_by_value(F.col("t"), F.col("o"))).first()
    assert row[0] == letters


@pytest.mark.parametrize("text, items", [("", []), (",", [""]), ("a,,b", ["a", "", "b"]), ("(a, [b, c)], d), e", ["(a, [b, c)], d)", "e"]), ("\\(x, \\,y", ["\\(x", "\\,y"]), ("(open, all, the, way", ["(open, all, the, way"]), ("a), b", ["a)", "b"]), ("<1, 2>, {3\\}, 4}, ", ["<1, 2>", "{3\\}, 4}"]), ("x\\", ["x\\"]), ("(" * 5_000 + ",", ["(" * 5_000 + ","])])
def test_typed_items(text, items):
    assert judging.typed_items(text) == items
