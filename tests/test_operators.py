"""Operators on small tables, edge cases and properties."""

import collections
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeloom.functions import answers as A
from gradeloom.functions import prompts as P
from gradeloom.functions import text as X
from gradeloom.operators import expressions as E
from gradeloom.operators import grading, joining, judging, repairing, reporting, scoring, similarity, splitting
from gradeloom.operators import energy
from gradeloom.plans import catalogue

CASES = [("3", ["3"], True), ("yes", ["1"], True), ("(1,2)", ["(2,1)"], True), ("BC", ["CB"], True), ("abc", [""], True), ("1,2", ["1"], False), ("[2,3)", ["[2,4)"], False), ("0.333333333", ["1/3"], True), ("Paris", ["paris"], True), ("x^2+2x+1", ["(x+1)^2"], True), ("\\frac12", ["0.5"], True), ("2x", ["3x"], False), ("\\sqrt{8}", ["2\\sqrt{2}"], True), ("-3", ["3"], False), ("(-\\infty,2)\\cup(3,4]", ["(-\\infty,2)\\cup(3,4]"], True), ("1.0", ["yes"], False), ("Tue", ["Tuesday"], True), ("3,4", ["3", "4"], True), ("4,3", ["3", "4"], False), ("\\sin^2x+\\cos^2x+1", ["2"], True), ("2.5\\times10^{3}", ["2500"], True)]


@pytest.mark.parametrize("answer, gold, ok", CASES)
def test_judge(answer, gold, ok):
    assert judging.judge("so \\boxed{" + answer + "}", gold) is ok


def test_nothing_extracted_is_wrong():
    assert not judging.judge("no idea", ["1"]) and judging.extract("we get 1,234.") == "1234"


@pytest.mark.parametrize("text, answer", [("a \\boxed{1} and \\boxed{2}, \\boxed{3}", "2, 3"), ("The answer is $x+1$.", "x+1"), ("#### 7", "7"), ("Therefore 5 is the answer", "5"), ("<think>\\boxed{0}</think> \\boxed{4}", "4"), ("it is $y$ and $z$", "z"), ("none", "")])
def test_extract(text, answer):
    assert judging.extract(text) == answer


@given(st.lists(st.integers(-9, 9), min_size=1, max_size=4), st.integers(-5, 5))
@settings(max_examples=60, deadline=None)
def test_shifted_polynomials_are_the_same(c, k):
    one = "+".join(f"({a})*x^{i}" for i, a in enumerate(c))
    assert E.same(one, f"{one}+({k})-({k})")
    assert not E.same(one, f"{one}+x^7+{abs(k) + 1}")


@pytest.mark.parametrize("a, b, ok", [("sin(2x)", "2sin(x)cos(x)", True), ("\\frac{x^2-1}{x-1}", "x+1", True), ("\\log_2 8", "3", True), ("\\sqrt[3]{27}", "3", True), ("5!", "120", True), ("|-3|", "3", True), ("e^{\\pi}", "23.1406926327792690", True), ("xy", "yx", True), ("x+y", "x-y", False)])
def test_expressions(a, b, ok):
    assert E.same(a, b) is ok


def test_equations_up_to_a_factor():
    assert E.same_equation("y=2x+1", "2y=4x+2") and not E.same_equation("y=2x+1", "y=2x+2")


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(column(F.col("t"))).collect()]


def test_boxes_agree_with_the_deep_scan(spark):
    rng = random.Random(1)
    parts = ["\\boxed{0}", "\\boxed{a{b}c}", "\\boxed{}", " , ", " and ", "\n", "x", "\\boxed{{{1}}}", "$;$"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(300)]
    group = values(spark, texts, A.last_box_group)
    assert [[x for x in g if x] for g, t in zip(group, texts, strict=True) if "\\boxed{}" not in t] == [judging.box_group(t) for t in texts if "\\boxed{}" not in t]


def test_splits_agree(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab,()[]<> $") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    native = values(spark, texts, A.top_level_split)
    assert [n for n, t in zip(native, texts, strict=True) if not t.endswith(",")] == [judging.split_items(t) for t in texts if not t.endswith(",")]


def test_text_functions(spark):
    assert values(spark, ["  a\r\nb\rc\n\n\n\nd "], X.clean_text) == ["a\nb\nc\n\nd"]
    assert values(spark, ["yes", " F ", "maybe"], X.as_boolean) == ["True", "False", None]
    assert values(spark, ["Thurs", "sun", "x"], X.as_weekday) == ["Thursday", "Sunday", None]
    assert values(spark, ["1,234.50", "$3.1%", "2", "x", "1.5e3"], X.decimals) == [2, 1, 0, None, 1]
    assert values(spark, ["<a & 'b'>"], X.html_escape) == ["&lt;a &amp; &#x27;b&#x27;&gt;"]
    assert values(spark, [" a/b c "], X.safe_name) == ["a_b_c"]
    assert values(spark, ["x" * 600], X.short_text)[0] == "x" * 497 + "..."
    assert values(spark, ["wait, so", "12", "a\nb"], A.looks_like_reasoning) == [True, False, True]


def test_rounding_places(spark):
    asked = ["Round to two decimal places", "round your answer to 3 decimal places", "nearest tenth and nearest cent", "to the nearest 0.010", "accurate at least to nearest tenth", "none"]
    assert values(spark, asked, grading.rounding_places) == [[2], [3], [1, 2], [2], [], []]


def test_audit(spark):
    row = spark.createDataFrame([("Pick A. x B. y", ["K"], True, 0), ("Give the exact value [ANS]", ["0.5"], False, 0), ("Find [ANS]", ["3"], False, 0), ("Find [ANS]", ["3 cm because"], False, 0)], "q string, a array<string>, m boolean, o int")
    flags = grading.audit_flags(F.col("q"), F.col("a"), F.col("m"), F.col("o"))
    got = [(r[0], r[1]) for r in row.select(flags.alias("f"), grading.audit_status(flags)).collect()]
    assert got == [(["mcq_answer_invalid"], "DROP"), (["exact_decimal_conflict"], "DROP"), ([], "KEEP"), (["sentence_answer", "unit_in_answer"], "REVIEW")]


def test_prompts(spark):
    messages = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("user", "q"), ("assistant", "a"), ("user", "r"))))
    tokens = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(s).alias("start")) for i, s in ((5, 0), (6, 4), (7, 9))))
    r = spark.range(1).select(P.last_assistant(messages), P.roles_are(messages, "user", "assistant", "user"), P.label_mask(tokens, F.lit(4)), P.prompt(F.lit("q"), F.lit(""), F.lit("p")), P.chosen_finish(F.array(F.lit("a"), F.lit("b")), F.lit(9), F.lit(None).cast("string"))).first()
    assert list(r) == ["a", True, [-100, 6, 7], "q\n\np", "a"]


def test_joins_that_must_find_every_row(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, "x")], "id long, v string")
    with pytest.raises(joining.MissingRows):
        joining.require(a, b, "id")
    assert joining.covered(a.filter("id = 1"), b).count() == 1


def test_as_of_takes_the_last_before(spark):
    events = spark.createDataFrame([(1, 5, 50), (1, 7, 70), (1, 7, 71), (2, 1, 10)], "k long, at long, v long")
    marks = spark.createDataFrame([(1, 4, "a"), (1, 7, "b"), (1, 9, "c"), (3, 1, "d")], "k long, at long, name string")
    got = {r.name: (r.v, r.at_found) for r in joining.as_of(events, marks, "k", "at", "v").collect()}
    assert got == {"a": (None, None), "b": (71, 7), "c": (71, 7), "d": (None, None)}


def test_votes(spark):
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "b", 2), (1, "a", 3), (2, "", 0), (2, None, 1), (3, "", 0), (3, "z", 5)], "id long, key string, idx long")
    got = {r.id: (r.key, r.votes, r.first_position) for r in scoring.majority(rows, "id", "key", "idx").collect()}
    assert got == {1: ("a", 2, 0), 2: ("", 0, 0), 3: ("z", 1, 5)}


@given(st.lists(st.integers(1, 30), min_size=1, max_size=6), st.integers(0, 40))
@settings(max_examples=8, deadline=None)
def test_quotas_add_up(spark, groups, size):
    rows = spark.createDataFrame([(f"g{i}", 100 * i + j) for i, n in enumerate(groups) for j in range(n)], "g string, id long")
    if size > sum(groups):
        with pytest.raises(ValueError):
            splitting.quotas(rows, ["g"], size)
        return
    got = splitting.quotas(rows, ["g"], size).collect()
    assert sum(r.quota for r in got) == size and all(0 <= r.quota <= r.available for r in got)
    assert splitting.stratified(rows, ["g"], "id", size, 1).count() == size


def test_splits_are_disjoint(spark):
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 3).alias("g"))
    parts = splitting.split3(rows, ["g"], "id", 5)
    assert parts.count() == 200 and splitting.disjoint(parts, "id", "split").count() == 0
    with pytest.raises(ValueError):
        splitting.ranges(rows, "id", 1, dev=300)
    with pytest.raises(ValueError):
        splitting.sampled(rows, "id", 300, 1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, quality int, lang string")
    r = scoring.accuracy(none, F.col("quality") == 1, F.col("lang") == "en").first()
    assert r.total == 0 and r.accuracy == 0.0
    assert splitting.part_numbers(none, "id", 10).count() == 0 and joining.repeated(none, "id").count() == 0


def test_energy(spark):
    rows = spark.createDataFrame([("a", 0.0, 10.0), ("a", 10.0, None), ("a", 20.0, 30.0), ("a", 30.0, 50.0)], "s string, t double, w double").withColumn("at", F.timestamp_seconds("t"))
    got = [(r.seconds, r.joules) for r in energy.intervals(rows, ["s"], "at", "w").orderBy("t").collect()]
    assert got == [(10.0, 100.0), (10.0, 300.0), (10.0, 400.0)]
    d = spark.range(1).select(energy.counter_delta(F.lit(5.0), F.lit(3.0), F.lit(10.0)), energy.counter_delta(F.lit(5.0), F.lit(3.0)), energy.counter_delta(F.lit(3.0), F.lit(5.0))).first()
    assert list(d) == [8.0, None, 2.0]


def test_budgets_double():
    assert repairing.budgets(1000, 8000) == [1000, 2000, 4000, 8000] and repairing.budgets(10, 5) == []


def test_reports(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n long")
    assert reporting.markdown_table(rows, ["k"]).first()[0] == "| k | n |\n| --- | --- |\n| a | 1 |\n| b | 2 |"


def test_cosine_queries_in_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    length = lambda v: sum(x * x for x in v) ** 0.5
    want = []
    for q, v in rows[::10]:
        near = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)) / length(v) / length(w), 5), c) for c, w in rows if c != q)[:3]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(near)]
    for block in (7, 1_000):
        got = similarity.cosine_top_k(vectors, F.col("vec_id") % 10 == 0, 3, block=block)
        assert sorted(map(tuple, got.collect())) == want


def test_cosine_search_takes_every_hundredth_id(spark):
    folder = "/root/testdata/sf0.01"
    ids = {r[0] for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").collect()}
    got = catalogue.QUERIES["embedding_cosine_topk"](spark, folder).select("query_id").distinct().collect()
    assert {r[0] for r in got} == {i for i in ids if i % 100 == 0}


@pytest.mark.parametrize("name", ["energy_tou_cost", "energy_summary"])
def test_holidays_of_every_year_of_the_events(spark, tmp_path, name):
    # Independence Day of 2025 and Christmas Day of 2026, a Friday each, from 8 to 9 in the morning: super_off as on weekends.
    events = spark.sql("SELECT * FROM VALUES (1L, 1L, timestamp_ntz'2025-07-04 08:00:00', 1000D), (1L, 2L, timestamp_ntz'2025-07-04 09:00:00', 1000D), (2L, 3L, timestamp_ntz'2026-12-25 08:00:00', 1000D), (2L, 4L, timestamp_ntz'2026-12-25 09:00:00', 1000D) t(user_id, event_id, ts, value)")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.cost_usd for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {1: energy.RATES["summer"]["super_off"], 2: energy.RATES["winter"]["super_off"]}
    spark.read.parquet(f"{tmp_path}/events.parquet").filter("false").write.parquet(f"{tmp_path}/none/events.parquet")
    assert catalogue.QUERIES[name](spark, f"{tmp_path}/none").count() == 0


def test_benchmark_passages_in_documents_are_found(spark, tmp_path):
    passages = ["the quick brown fox jumps over the lazy dog", "numbers and letters make a sum"]
    texts = ["nothing of it", f"before {passages[1]} after", passages[0], "the dog is lazy"]
    spark.createDataFrame([*enumerate(passages)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(10 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def grams(text):
        words = [f" {w} " for w in text.lower().split()]
        return collections.Counter(g for w in words for n in (3, 4, 5) for g in ([w] if n == 3 and len(w) < 3 else [w[i : i + n] for i in range(len(w) - n + 1)]))

    every = [grams(t) for t in passages + texts]
    df = collections.Counter(g for c in every for g in c)

    def vector(c):
        raw = {g: (1 + math.log(n)) * (math.log((1 + len(every)) / (1 + df[g])) + 1) for g, n in c.items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {g: x / size for g, x in raw.items()}

    vectors = [vector(c) for c in every]
    want = []
    for q in (0, 1):
        near = sorted((-round(s, 6), 10 + i) for i, v in enumerate(vectors[2:]) if (s := sum(x * v.get(g, 0) for g, x in vectors[q].items())))[:3]
        want += [(q, n + 1, c, pytest.approx(-s, abs=2e-6)) for n, (s, c) in enumerate(near)]
    got = catalogue.QUERIES["topk_similarity_documents"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "candidate_id", "similarity").collect()) == want
    best = catalogue.QUERIES["similarity_metrics_documents"](spark, str(tmp_path)).first()
    assert best.queries == 2 and best.at_least_50 == 2


def test_running_sums_by_ranges_equal_those_of_a_window(spark, monkeypatch):
    from gradeloom.operators import splitting

    rows = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"g{i % 4}") for i in range(400)], "id long, g string").repartition(5)
    want = {r.id: r.position for r in splitting.numbered(rows, ["g"], "id", 7).collect()}
    parts = {r.id: r.part for r in splitting.part_numbers(rows, "id", 30).collect()}
    monkeypatch.setattr(splitting, "ONE_TASK", 10)
    assert {r.id: r.position for r in splitting.numbered(rows, ["g"], "id", 7).collect()} == want
    assert {r.id: r.part for r in splitting.part_numbers(rows, "id", 30).collect()} == parts == {i: i // 30 for i in range(400)}


@pytest.mark.parametrize("one_task", [5, 500_000])
def test_quantiles_equal_those_of_sorted_values(spark, monkeypatch, one_task):
    import numpy as np

    from gradeloom.operators import splitting

    monkeypatch.setattr(splitting, "ONE_TASK", one_task)
    values = [(g, float((i * 37) % 101) / 3) for g in ("a", None) for i in range(150)] + [("b", 2.5), ("b", None), ("c", 1.0), ("c", 4.0)]
    rows = spark.createDataFrame(values, "g string, v double")
    got = {r.g: r.quantiles for r in splitting.quantiles(rows, ["g"], "v", [0.0, 0.01, 0.5, 0.99, 1.0]).collect()}
    for g in got:
        assert got[g] == pytest.approx(np.quantile([v for h, v in values if h == g and v is not None], [0.0, 0.01, 0.5, 0.99, 1.0]).tolist())
    assert len(got) == 4


def test_phrases_of_many_lengths_and_hot_openings(spark):
    from gradeloom.operators import joining

    texts = [(i, "the same five words here " * 30 + f"and then number {i}") for i in range(20)] + [(20, ""), (21, "one"), (22, " two  words\n")]
    items = [(0, "the same five words here the"), (1, "and then number 7"), (2, "one"), (3, "two words"), (4, ""), (5, "the same five words there"), (6, "words here and then number 11"), (7, "the same five words here " * 31)]
    got = joining.phrases(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame(items, "item long, item_text string"), "item", "item_text")
    plain = lambda t: f" {' '.join(t.split())} "
    want = {(j, i) for i, t in texts for j, x in items if x.split() and plain(x) in plain(t)}
    assert {(r.item, r.id) for r in got.collect()} == want and len(got.collect()) == len(want)


@pytest.mark.parametrize(
    "box, gold, ok",
    [
        ("3", ["3"], True), ("yes", ["1"], True), ("(1,2)", ["(2,1)"], True), ("BC", ["CB"], True), ("abc", [""], True), ("1,2", ["1"], False), ("[2,3)", ["[2,4)"], False),
        ("0.333333333", ["1/3"], True), ("Paris", ["paris"], True), ("\\ln(x^2)", ["2\\ln(x)"], True), ("abs(x)", ["\\sqrt{x^2}"], True), ("abs(x)", ["x+1"], False), ("[2,3]", ["[2,3)"], True), ("x+1", ["1+x"], True), ("\\sqrt{x^2}", ["x"], False), ("2y+1=4x", ["y+0.5=2x"], True),
    ],
)
def test_judge_pairs(box, gold, ok):
    from gradeloom.operators import judging

    assert judging.judge(f"so \\boxed{{{box}}}", gold) is ok


def test_documents_that_hold_a_phrase_equal_the_sql(spark, tmp_path):
    """A document's own words, made of syllables, can hold "is the ans"; the query took what stands between two of these, its SQL what stands before the first."""
    import duckdb

    own = ["ateror this the ansttionea erbleo", "3, is the ans. is the answ", "this our anst 5", "plain $x$ words", ""]
    rows = [(7 * n + k, t, len(t)) for n, t in enumerate(own) for k in range(7)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.answer for r in catalogue.QUERIES["explicit_answer"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(db.execute(catalogue.ORACLES["explicit_answer"]).fetchall())
    text = spark.range(1).select(A.explicit_answer(F.lit("this the anst so 4 is the ans")).alias("a"))
    assert text.first().a == "t so 4"


def test_audit_makes_each_question_once(spark, tmp_path):
    """The question's expression stood in the plan wherever a flag names the question, and was evaluated there."""
    spark.range(20).selectExpr("id AS l_orderkey", "id AS l_partkey", "CAST(id % 7 AS INT) AS l_linenumber").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = catalogue.QUERIES["audit_flags"](spark, str(tmp_path))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("To the nearest tenth") <= 1
    assert rows.count() == 20


def test_self_check_makes_a_response_once(monkeypatch):
    """The response was made twice a row, and read three times."""
    import pandas as pd

    made, read = [], []
    monkeypatch.setattr(judging, "answer_block", lambda a, q, f=judging.answer_block: made.append(a) or f(a, q))
    monkeypatch.setattr(judging, "extract", lambda t, f=judging.extract: read.append(t) or f(t))
    answers = pd.Series([["7"], ["1, 2"], None, ["(1, 2)", None], []])
    got = [x.tolist() if hasattr(x, "tolist") else x for x in next(judging.self_check.func(iter([(answers, pd.Series(["", None, "q", "", ""]))])))]
    assert got == [[], ["judge_count_mismatch"], ["judge_self_check_failed"], [], ["judge_self_check_failed"]]
    assert len(made) == 4 and len(read) <= 8


def test_cosines_of_blocks_equal_all_pairs(spark):
    """Each pair was an interpreted loop over components; copies and negative cosines among the rows."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(2, 8)), 60, axis=0), -np.ones((3, 8)), np.zeros((1, 8))]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for block in (1_000, 7):
        got = {(r.query_id, r["rank"]): (r.candidate_id, r.cosine) for r in similarity.cosine_top_k(rows, F.col("vec_id") % 20 == 0, 4, block=block).collect()}
        want = {}
        y = x.astype(float)
        n = np.sqrt((y * y).sum(1))
        for q in range(0, len(x), 20):
            ranked = sorted((-round(sum(a * b for a, b in zip(y[q], y[c])) / (n[q] * n[c]), 5), c) for c in range(len(x)) if c != q and n[c] and n[q])
            want |= {(q, i): (c, -s) for i, (s, c) in enumerate(ranked[:4], 1)}
        assert got == want
    plan = similarity.cosine_top_k(rows, F.col("vec_id") % 20 == 0, 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
