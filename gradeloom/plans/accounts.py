"""Accounts of runs: states of inputs and outputs, measures of format, summaries by configuration, strata, rates, boxes and letters of several kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import energy as E
from ..operators import grading as G
from ..operators import judging
from ..operators import reconciling
from ..operators import scoring as S
from ..operators.cutting import spread
from . import recipes as R
from .registry import query, table
from .series import _PRICES, _STEPS, _intervals

_RECONCILED = """
WITH i AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey % 9 <> 4), o AS (SELECT l_orderkey AS id, concat_ws('; ', CASE WHEN l_quantity < 4 THEN 'short' END, CASE WHEN l_discount > 0.09 THEN 'cheap' END) AS error FROM lineitem WHERE l_linenumber = 1 OR (l_linenumber = 3 AND l_tax > 0.07)),
m AS (SELECT id, count(*) AS n, max(nullif(error, '')) AS error FROM o GROUP BY id), f AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2),
s AS (SELECT coalesce(i.id, m.id) AS id, CASE WHEN i.id IS NULL THEN 'orphan' WHEN m.error IS NOT NULL THEN 'invalid' WHEN n IS NOT NULL AND f.id IS NOT NULL THEN 'conflicting' WHEN n > 1 THEN 'duplicate' WHEN n IS NOT NULL THEN 'success' WHEN f.id IS NOT NULL THEN 'failed' ELSE 'missing' END AS state, coalesce(n, 0) AS outputs, m.error
    FROM i FULL JOIN m ON i.id = m.id LEFT JOIN f ON f.id = coalesce(i.id, m.id))
"""


def _states(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "id")
    outputs = lines.filter("l_linenumber = 1 OR (l_linenumber = 3 AND l_tax > 0.07)")
    errors = F.array_compact(F.array(F.when(F.col("l_quantity") < 4, "short"), F.when(F.col("l_discount") > 0.09, "cheap")))
    inputs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).filter("id % 9 <> 4")
    return reconciling.states(inputs, outputs, lines.filter("l_returnflag = 'R' AND l_linenumber = 2"), "id", errors)


@query("merge_states", _RECONCILED + "SELECT id, state, outputs, error FROM s")
def merge_states(spark, d):
    """Orders against first lines as outputs and returned second lines as failures, orphans among them."""
    return _states(spark, d)


@query("merge_counts", _RECONCILED + f"SELECT count(*) AS keys, {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in reconciling.STATES)}, count(*) FILTER (state NOT IN ('success', 'failed')) = 0 AS complete FROM s")
def merge_counts(spark, d):
    return reconciling.counts(_states(spark, d))


_RESPONSES = """SELECT conv_id, turn, CASE WHEN length(text) > 600 THEN 'LENGTH' WHEN turn % 4 = 3 THEN '' ELSE 'stop' END AS finish, conv_id % 3 = 0 AS is_mcq, regexp_extract(text, '([A-C])[a-z]', 1) AS letter, length(text) - length(replace(text, ',', '')) AS items, turn % 3 AS gold,
  trim(text) AS response, text AS raw, conv_id % 5 = 0 AS fallback_used, turn = 1 AS stage0_repair_used, CASE WHEN conv_id % 7 > 3 THEN role = 'user' END AS postprocess_used, role FROM {t}"""


@query("format_measures", f"""
WITH r AS ({_RESPONSES.format(t='conversations')})
SELECT role, count(*) FILTER (finish NOT IN ('', 'stop')) AS truncation_count, count(*) FILTER (NOT is_mcq AND items = 0) AS no_extraction_count, count(*) FILTER (NOT is_mcq AND items <> 0 AND items <> gold) AS count_mismatch_count, count(*) FILTER (is_mcq AND letter = '') AS mcq_format_error_count,
  count(*) FILTER (fallback_used) AS fallback_used, count(*) FILTER (stage0_repair_used) AS stage0_repair_used, count(*) FILTER (postprocess_used) AS postprocess_used, count(*) FILTER (NOT is_mcq) AS free_total, count(*) FILTER (is_mcq) AS mcq_total, round(avg(length(response)), 6) AS avg_response_chars, round(avg(length(raw)), 6) AS avg_raw_response_chars,
  count(*) FILTER ((NOT is_mcq AND (items = 0 OR items <> gold)) OR (is_mcq AND letter = '')) AS format_error_count FROM r GROUP BY role""")
def format_measures(spark, d):
    rows = spark.sql(_RESPONSES.format(t="{conversations}"), conversations=table(spark, d, "conversations"))
    out = S.format_measures(rows, ["role"])
    return out.withColumns({c: F.round(c, 6) for c in ("avg_response_chars", "avg_raw_response_chars")})


_ERRORS = ["truncated", "no_answer", "wrong_value", "none"]
_RUNS = "SELECT event_type AS prompt, user_id % 4 AS config, value > 40 AS ok, CASE WHEN value > 40 THEN 'none' WHEN event_id % 3 = 0 THEN 'truncated' WHEN event_id % 3 = 1 THEN 'no_answer' ELSE 'wrong_value' END AS error FROM {t}"


@query("run_summary", f"""
WITH r AS ({_RUNS.format(t='events')}) SELECT prompt, config, count(*) AS n, count(*) FILTER (ok) AS correct, round(count(*) FILTER (ok) / count(*), 6) AS acc, {', '.join(f"count(*) FILTER (error = '{e}') AS err_{e}" for e in _ERRORS)} FROM r GROUP BY ALL""")
def run_summary(spark, d):
    rows = spark.sql(_RUNS.format(t="{events}"), events=table(spark, d, "events"))
    return S.summary(rows, ["prompt", "config"], F.col("ok"), "error", _ERRORS).withColumn("acc", F.round("acc", 6))


_ASKED = "repeat('[ANS] ', CAST(doc_id % 11 AS INT)) || CASE WHEN doc_id % 13 = 5 THEN 'A Table of ' WHEN doc_id % 13 = 6 THEN chr(92) || 'begin{array} ' ELSE '' END || text"


@query("strata_keys", f"""
WITH q AS (SELECT doc_id, {_ASKED} AS q, doc_id % 4 = 1 AS mcq FROM documents), n AS (SELECT *, {R.count('q', '[ANS]')} AS n FROM q), t AS (SELECT *, CASE WHEN n >= 6 OR contains(lower(q), 'table') OR contains(q, chr(92) || 'begin{{array}}') THEN 'table' ELSE 'normal' END AS t FROM n)
SELECT least(n, 8) || '|' || t AS blanks, CASE WHEN mcq THEN 'mcq' ELSE 'free' END || '|' || least(n, 6) || '|' || t AS format, count(*) AS n FROM t GROUP BY ALL""")
def strata_keys(spark, d):
    q = F.col("q")
    rows = table(spark, d, "documents").select(F.expr(_ASKED).alias("q"), F.when(F.col("doc_id") % 4 == 1, F.array(F.lit("a"))).alias("o"))
    return rows.groupBy(G.blanks_stratum(q).alias("blanks"), G.format_stratum(q, F.col("o")).alias("format")).agg(F.count("*").alias("n"))


_PLANS = {"tou": "rate", "tier1": "rate - 0.10892::DOUBLE", "flat": "0.31::DOUBLE"}


@query("energy_plans", _STEPS.rstrip() + _PRICES + " UNION ALL ".join(f"SELECT '{k}' AS plan, {"'flat'" if k == 'flat' else 'period'} AS period, {"'all'" if k == 'flat' else 'season'} AS season, count(*) AS intervals, round(sum(joules / 3.6e6::DOUBLE), 5) AS kwh, round(sum(joules / 3.6e6::DOUBLE * ({v})), 5) AS cost_usd FROM r GROUP BY ALL" for k, v in _PLANS.items()))
def energy_plans(spark, d):
    """All intervals' energy and cost by plan: by time of use, with the first tier's credit, at one rate."""
    first, last = table(spark, d, "events").agg(F.min(F.year("ts")), F.max(F.year("ts"))).first()
    days = E.holidays(spark, first, last) if first else E.holidays(spark, 1, 0)
    rows = _intervals(spark, d)
    out = None
    for name, more in (("tou", {}), ("tier1", {"credit": True}), ("flat", {"flat": 0.31})):
        some = E.priced(rows, days, **more).withColumn("plan", F.lit(name))
        out = some.select("plan", "period", "season", "joules", "kwh", "cost") if out is None else out.unionByName(some.select("plan", "period", "season", "joules", "kwh", "cost"))
    return out.groupBy("plan", "period", "season").agg(F.count("*").alias("intervals"), F.round(F.sum("kwh"), 5).alias("kwh"), F.round(F.sum("cost"), 5).alias("cost_usd"))


_FRAMED = R.case("doc_id % 6", f"left(text, 20) || {R.box("'a' || doc_id")} || ' or ' || chr(92) || 'fbox{{' || left(lang, 1) || n_chars || '}}'", f"{R.box("'{' || doc_id || '}'")} || left(text, 9)", "'so ' || chr(92) || 'boxed{' || doc_id || ' and ' || left(source, 4)", "'none ' || left(text, 30)", f"'FINAL_ANSWERS: ' || {R.box("n_chars")}", f"{R.box("'early'")} || ' FINAL_ANSWERS ' || chr(92) || 'boxed{{' || doc_id").replace("{{", "{").replace("}}", "}")


@query("box_kinds", rf"""
WITH q AS (SELECT doc_id, {_FRAMED} AS t FROM documents), p AS (SELECT *, regexp_replace(t, '\\fbox\{{', '\\boxed{{', 'g') AS b FROM q),
r AS (SELECT *, regexp_replace(b, '\\boxed\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}}', '', 'g') AS rest FROM p)
SELECT doc_id, CASE WHEN {R.last_box('b')} <> '' THEN {R.last_box('b')} WHEN contains(rest, '\boxed{{') THEN trim({R.last("string_split(rest, chr(92) || 'boxed{')")}) ELSE '' END AS framed,
  coalesce(CASE WHEN contains(t, 'FINAL_ANSWERS') THEN nullif({R.last_box(R.last("string_split(t, 'FINAL_ANSWERS')"))}, '') END, '-') AS final FROM r""")
def box_kinds(spark, d):
    t = F.col("t")
    return table(spark, d, "documents").select("doc_id", F.expr(_FRAMED).alias("t")).select("doc_id", A.last_framed(t).alias("framed"), F.coalesce(A.answer_box(t), F.lit("-")).alias("final"))


_CHOSEN = R.case("p_partkey % 6", R.box("(p_partkey % 5) || '.50'"), R.box("chr(92) || 'frac{' || (1 + 2 * (p_partkey % 5)) || '}{2}'"), f"'option (B) or ' || {R.box("'none of ' || p_name")}", R.box("'bd'"), f"'Selected: ACE, done ' || left(p_name, 5)", R.box("'0.5+' || (p_partkey % 5)"))


@query("letters_by_value", rf"""
WITH q AS (SELECT p_partkey, {_CHOSEN} AS t FROM part), b AS (SELECT *, {R.last_box('t')} AS box, list_transform(regexp_extract_all({R.last_box('t')}, '\d+(?:\.\d+)?'), lambda x: x::DOUBLE) AS n, upper({R.last(r"regexp_extract_all(t, '(?i)(?:selected|option)\s*[:\s]*\(?([A-Z]+)\)?\b', 1)")}) AS said FROM q)
-- The options are a half more than 0 to 4, the first three as quotients.
SELECT p_partkey, CASE WHEN regexp_matches(upper(box), '^[A-E]+$') THEN upper(box) WHEN contains(box, 'frac') THEN chr(65 + (n[1] / n[2] - 0.5)::INT) WHEN contains(box, '+') THEN chr(65 + (n[1] + n[2] - 0.5)::INT) WHEN len(n) = 1 AND regexp_matches(box, '^[\d.]+$') THEN chr(65 + (n[1] - 0.5)::INT) WHEN regexp_matches(said, '^[A-E]+$') THEN said ELSE '' END AS letters FROM b""")
def letters_by_value(spark, d):
    """Letters of responses whose boxes hold an option's value, not its text."""
    options = F.array(*(F.lit(x) for x in ("\\frac{1}{2}", "\\frac{3}{2}", "5/2", "3.5", "4.5")))
    return spread(table(spark, d, "part")).select("p_partkey", judging.letters_by_value(F.expr(_CHOSEN), options).alias("letters"))
