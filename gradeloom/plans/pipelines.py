"""Fallback stages, worker records, the judge, prompts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import prompts as P
from ..functions import text as X
from ..operators import grading as G
from ..operators import judging, repairing, reporting
from ..operators.cutting import spread
from . import recipes as R
from .registry import query, table
from .texts import format_sql


#: Candidates of each stage: response and how it ended.
_CANDIDATES = {
    "repair": (R.case("id % 4", R.box("id"), R.box("'wait, let''s see'"), "'nothing'", R.box("' '")), "CASE WHEN id % 4 = 1 THEN 'length' ELSE 'stop' END"),
    "continuation": (f"CASE WHEN id % 4 <= 1 OR id % 5 = 0 THEN 'so ' || {R.box('id + 1')} ELSE 'nothing' END", "'stop'"),
    "bounded": (f"CASE WHEN id % 3 <= 1 THEN 'end <think>' || {R.box("'0'")} || '</think>' || {R.box("'7, ' || id")} ELSE 'nothing' END", "'length'"),
}


@query("stage_fallback", f"""
WITH o AS (SELECT o_orderkey AS id FROM orders), c AS ({' UNION ALL '.join(f"SELECT id, {i} AS n, '{k}' AS stage, {r} AS response, {f} AS finish FROM o" for i, (k, (r, f)) in enumerate(_CANDIDATES.items(), 1))}),
g AS (SELECT *, array_to_string({R.last_group(R.after_think('response'))}, ', ') AS answer, len({R.last_group(R.after_think('response'))}) AS boxes FROM c),
t AS (SELECT *, boxes > 0 AND NOT (finish = 'length' AND (length(answer) > 250 OR regexp_matches(lower(answer), 'let''s|wait|case|suppose|strategy|turn|therefore|because|we need|the problem'))) AS ok FROM g),
f AS (SELECT id, min(n) FILTER (WHERE ok) AS first FROM t GROUP BY id)
SELECT f.id, coalesce(t.response, 'none') AS response, coalesce(t.stage, 'none') AS stage, CAST(coalesce(first, 3) AS BIGINT) AS attempts FROM f LEFT JOIN t ON t.id = f.id AND t.n = first""")
def stage_fallback(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    parts = [orders.select("id", F.lit(k).alias("stage"), F.expr(r).alias("response"), F.expr(f).alias("finish_reason")) for k, (r, f) in _CANDIDATES.items()]
    candidates = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return repairing.staged(orders.withColumn("response", F.lit("none")), candidates, "id", repairing.STAGES, repairing.acceptable(F.col("response"), F.col("finish_reason")))


#: A worker's record beside its task, which asks "do", with the id, for the output "1".
_RECORD = {"id": "doc_id + CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END", "instruction": "CASE WHEN doc_id % 11 = 0 THEN 'undo' ELSE 'do' END", "reasoning": f"{R.case('doc_id % 6', "'because'", "' '", f"'so ' || {R.box('doc_id')}", "'final_answers: 1'", "'<think>' || doc_id || '</think>'", "text")}", "output": "CAST(1 + doc_id % 2 AS STRING)", "warning": "CASE WHEN doc_id % 7 = 4 THEN NULL ELSE '' END", "source": "CASE WHEN doc_id % 3 = 2 THEN 'other' ELSE 'worker_single' END"}


@query("worker_validation", rf"""
WITH r AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _RECORD.items())} FROM documents), l AS (SELECT *, lower(reasoning) AS low FROM r)
SELECT doc_id, array_to_string(list_filter([CASE WHEN id <> doc_id THEN 'id changed' END, CASE WHEN instruction <> 'do' THEN 'instruction changed' END, CASE WHEN output <> '1' THEN 'output changed' END, CASE WHEN trim(reasoning) = '' THEN 'reasoning missing or empty' END,
  CASE WHEN len(regexp_extract_all(reasoning, '\S+')) > 320 THEN 'reasoning exceeds 320 words' END, CASE WHEN contains(low, 'final_answers') THEN 'reasoning contains FINAL_ANSWERS' END, CASE WHEN contains(reasoning, '\boxed') THEN 'reasoning contains boxed final answer' END, CASE WHEN contains(low, '<think') THEN 'reasoning contains think tags' END,
  CASE WHEN warning IS NULL THEN 'warning is missing or not a string' END, CASE WHEN source <> 'worker_single' THEN 'source must be worker_single' END], lambda x: x IS NOT NULL), '|') AS errors FROM l""")
def worker_validation(spark, d):
    record = F.struct(*(F.expr(v).alias(k) for k, v in _RECORD.items()))
    task = F.struct(F.col("doc_id").alias("id"), F.lit("do").alias("instruction"), F.lit("1").alias("output"))
    return table(spark, d, "documents").select("doc_id", record.alias("r"), task.alias("t")).select("doc_id", F.array_join(repairing.worker_errors("r", "t"), "|").alias("errors"))


_JSON = """CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || '```' WHEN 1 THEN props WHEN 2 THEN '[' || props || ']' ELSE '{"id": ' || event_id || ', "instruction": "x", "reasoning": "x", "output": "x", "warning": "", "' || CASE WHEN event_id % 3 = 0 THEN 'origin' ELSE 'source' END || '": "x"}' END"""


@query("worker_keys", f"""
WITH q AS (SELECT event_id, {_JSON} AS j FROM events), k AS (SELECT event_id, CASE WHEN json_valid(j) AND json_type(j) = 'OBJECT' THEN json_keys(j) END AS keys FROM q),
m AS (SELECT event_id, keys, list_sort(list_filter(['id', 'instruction', 'reasoning', 'output', 'warning', 'source'], lambda x: NOT list_contains(keys, x))) AS missing, list_sort(list_filter(keys, lambda x: NOT list_contains(['id', 'instruction', 'reasoning', 'output', 'warning', 'source'], x))) AS extra FROM k)
SELECT event_id, CASE WHEN keys IS NULL THEN 'not a JSON object' ELSE array_to_string(list_filter([CASE WHEN len(missing) > 0 THEN 'missing keys: ' || array_to_string(missing, ', ') END, CASE WHEN len(extra) > 0 THEN 'unexpected keys: ' || array_to_string(extra, ', ') END], lambda x: x IS NOT NULL), '|') END AS errors FROM m""")
def worker_keys(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(repairing.key_errors(F.expr(_JSON)), "|").alias("errors"))


@query("batch_collect", """
SELECT o_orderkey AS task, 'worker-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '-' || left(sha1(CAST(o_orderkey AS VARCHAR)), 10) AS custom_id, CASE o_orderkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'unseen' END AS state, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus END AS content FROM orders""")
def batch_collect(spark, d):
    orders = table(spark, d, "orders").withColumn("custom_id", X.request_id(F.col("o_orderkey"), F.col("o_orderkey")))
    body = F.to_json(F.struct(F.struct(F.when(F.col("o_orderkey") % 3 == 0, 200).otherwise(500).alias("status_code"), F.struct(F.array(F.struct(F.struct(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response")))
    results = orders.filter(F.col("o_orderkey") % 3 != 2).select("custom_id", body.alias("body"))
    return repairing.collected(orders.select(F.col("o_orderkey").alias("task"), "custom_id"), results).select("task", "custom_id", "state", "content")


#: Pairs of kinds: a quotient and a decimal, a pair in another order, intervals, sums, a list that is too long, words, decimals. Some of each kind differ.
_OFF = "(p_partkey % 3)"
_SAID = {"boxed": R.case("p_partkey % 7", f"chr(92) || 'frac{{' || p_partkey || '}}{{4}}'", "'(' || p_partkey || ', ' || (p_partkey + 1) || ')'", "'[' || p_partkey || ',' || (p_partkey + 5) || ')'", "'2x+' || p_partkey", "p_partkey || ',' || (p_partkey + 1)", "'Paris ' || p_partkey", "p_partkey || '.50'")}
_GOLD = R.case("p_partkey % 7", f"CAST((p_partkey + {_OFF}) / 4 AS STRING)", f"'(' || (p_partkey + 1) || ',' || (p_partkey + {_OFF}) || ')'", f"'[' || p_partkey || ',' || (p_partkey + 5 + {_OFF}) || ')'", f"(p_partkey + {_OFF}) || '+x+x'", "CAST(p_partkey AS STRING)", f"CASE WHEN {_OFF} = 0 THEN 'paris ' ELSE 'parma ' END || p_partkey", f"p_partkey || '.' || (5 + {_OFF})")


@query("judge_equal", rf"""
WITH q AS (SELECT p_partkey, 'so ' || {R.box(_SAID['boxed'])} AS response, {_GOLD} AS gold FROM part), b AS (SELECT *, {R.last_box('response')} AS said FROM q),
n AS (SELECT *, list_transform(regexp_extract_all(said, '\d+(?:\.\d+)?'), lambda x: CAST(x AS DOUBLE)) AS a, list_transform(regexp_extract_all(gold, '\d+(?:\.\d+)?'), lambda x: CAST(x AS DOUBLE)) AS g FROM b)
SELECT p_partkey, CASE WHEN contains(said, 'frac') THEN abs(a[1] / a[2] - g[1]) <= 1e-8 * abs(g[1]) WHEN starts_with(said, '(') THEN list_sort(a) = list_sort(g) WHEN starts_with(said, '[') THEN a = g AND right(said, 1) = right(gold, 1)
  WHEN contains(said, 'x') THEN a[-1] = g[1] AND a[1] = len(string_split(gold, 'x')) - 1 WHEN regexp_matches(said, '^[A-Za-z]') THEN lower(said) = lower(gold) ELSE len(a) = len(g) AND a[1] = g[1] END AS ok FROM n""")
def judge_equal(spark, d):
    return spread(table(spark, d, "part")).select("p_partkey", judging.judged(F.expr(f"'so ' || {R.box(_SAID['boxed'])}"), F.array(F.expr(_GOLD))).alias("ok"))


#: Pairs of expressions in one or two symbols; what is added on the right is a whole number, a thousand-millionth or nothing.
_A, _B, _D = "(1 + l_partkey % 17)", "(2 + l_suppkey % 11)", "CASE l_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '+' || (1 + l_linenumber) ELSE '+0.000000001' END"
_PAIRS = (
    (f"'(x+' || {_A} || ')(x-' || {_B} || ')'", f"'x^2+' || {_A} || 'x-' || {_B} || 'x-' || ({_A} * {_B})"),
    (f"chr(92) || 'frac{{{{x^2-' || ({_A} * {_A}) || '}}}}{{{{x-' || {_A} || '}}}}'", f"'x+' || {_A}"),
    (f"'(x+' || {_A} || 'y)^3'", f"'x^3+' || (3 * {_A}) || 'x^2y+' || (3 * {_A} * {_A}) || 'xy^2+' || ({_A} * {_A} * {_A}) || 'y^3'"),
    (f"chr(92) || 'frac{{{{1}}}}{{{{x+' || {_A} || '}}}}+' || chr(92) || 'frac{{{{1}}}}{{{{x-' || {_A} || '}}}}'", f"chr(92) || 'frac{{{{2x}}}}{{{{x^2-' || ({_A} * {_A}) || '}}}}'"),
    (f"'10^{{{{12}}}}x+' || {_A}", f"'1000000000000x+' || {_A}"),
)
_LEFT, _RIGHT = (R.case("l_linenumber % 5", *(p[i].replace("{{{{", "{").replace("}}}}", "}") for p in _PAIRS)) for i in (0, 1))


@query("expression_identity", rf"""
WITH q AS (SELECT l_orderkey, l_linenumber, l_linenumber % 5 AS family, {_LEFT} AS a, ({_RIGHT}) || {_D} AS b FROM lineitem),
-- Whole numbers of both sides; the last of the right, if it is more than the family has, is what was added.
n AS (SELECT *, list_transform(regexp_extract_all(a, '\d+'), lambda x: CAST(x AS BIGINT)) AS p, list_transform(regexp_extract_all(regexp_replace(b, '\+0\.0+1$', ''), '\d+'), lambda x: CAST(x AS BIGINT)) AS g, regexp_matches(b, '\+0\.0+1$') AS tiny FROM q),
-- Coefficients that each side has when it is multiplied out, by family.
c AS (SELECT *, CASE family WHEN 0 THEN g[1] = 2 AND g[2] - g[3] = p[1] - p[2] AND coalesce(g[5], 0) - g[4] = -p[1] * p[2] WHEN 1 THEN g[1] + coalesce(g[2], 0) = p[3] AND p[2] = p[3] * p[3] WHEN 2 THEN g[2] = 3 * p[1] AND g[4] = 3 * p[1] * p[1] AND g[6] = p[1] ** 3 AND len(g) = 7
  WHEN 3 THEN g[1] = 2 AND g[3] = p[2] * p[4] AND len(g) = 3 ELSE g[1] = 10 ** p[2] AND g[2] + coalesce(g[3], 0) = p[3] END AS whole FROM n)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT whole THEN 'different' WHEN tiny THEN 'near' ELSE 'identical' END AS sameness FROM c""")
def expression_identity(spark, d):
    rows = spread(table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", F.expr(_LEFT).alias("a"), F.expr(f"({_RIGHT}) || {_D}").alias("b"))
    return rows.select("l_orderkey", "l_linenumber", judging.compared("a", "b").alias("sameness"))


_OWN = f"CASE o_orderkey % 3 WHEN 0 THEN '1, ' || o_orderkey WHEN 1 THEN '(1, ' || o_orderkey || ')' ELSE chr(92) || 'frac{{' || o_orderkey || '}}{{7}}' END"


@query("self_consistency", f"SELECT o_orderkey FROM (SELECT o_orderkey, {_OWN} AS a FROM orders) WHERE len({R.split('a')}) = 1")
def self_consistency(spark, d):
    """Rows whose gold answer the judge accepts as equal to itself: those that are one item."""
    answer = F.expr(_OWN)
    return spread(table(spark, d, "orders")).filter(judging.judged(F.concat(F.lit("\\boxed{"), answer, F.lit("}")), F.array(answer))).select("o_orderkey")


_DEEP = f"{R.box("'a{b{c{d{e{' || n_nationkey || '}}}}}'")} || CASE WHEN n_nationkey % 2 = 0 THEN ', ' ELSE ' or ' END || {R.box("'{{{{{' || n_nationkey || '}}}}}'")} || ' ' || chr(92) || 'boxed{{open'"


@query("boxes_deep", f"SELECT n_nationkey, array_to_string({R.last_group('response')}, '|') AS answers FROM (SELECT n_nationkey, {_DEEP} AS response FROM nation)")
def boxes_deep(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.expr(_DEEP).alias("response"))
    return rows.select("n_nationkey", F.array_join(A.last_box_group(F.col("response")), "|").alias("answers"))


_REWARDED = f"{R.OWN} || 'work FINAL_ANSWERS: ' || {R.box("doc_id || '.5'")} || CASE WHEN doc_id % 3 = 0 THEN ' so' ELSE '' END"
_REWARD_GOLD = "doc_id || CASE WHEN doc_id % 2 = 0 THEN '.50' ELSE '.75' END"


@query("full_reward", f"""
WITH q AS (SELECT doc_id, {_REWARDED} AS response, {_REWARD_GOLD} AS gold FROM documents)
SELECT doc_id, round(2.0::DOUBLE * CASE WHEN CAST({R.last_box('response')} AS DOUBLE) = CAST(gold AS DOUBLE) THEN 1 ELSE 0 END + 0.4::DOUBLE * {format_sql('response', 'true')} + 0.2::DOUBLE, 6) AS reward FROM q""")
def full_reward(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr(_REWARDED).alias("r"), F.expr(_REWARD_GOLD).alias("g"))
    ok, shape = judging.judged(F.col("r"), F.array("g")).cast("double"), G.shape_ok(F.col("r"), F.lit(1), F.lit(False), F.lit(0))
    return rows.select("doc_id", F.round(G.full_reward(ok, G.format_reward(F.col("r"), shape), G.length_reward(F.col("r"))), 6).alias("reward"))


_WANTED = "1 + doc_id % 4"
_HAVE = f"CASE WHEN doc_id % 3 = 0 THEN '1,' || doc_id ELSE '1|' || doc_id || CASE WHEN doc_id % 3 = 1 THEN '|x' ELSE '' END END"


@query("expected_count", f"""
WITH q AS (SELECT doc_id, string_split({_HAVE}, '|') AS a, {_WANTED} AS n FROM documents)
SELECT doc_id, array_to_string(CASE WHEN n <= 1 THEN a[-1:] WHEN len(a) = n THEN a WHEN len(a) = 1 AND len(string_split(a[1], ',')) = n THEN string_split(a[1], ',') WHEN len(a) > n THEN list_slice(a, len(a) - n + 1, len(a)) ELSE [] END, '|') AS answers FROM q""")
def expected_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(A.match_count(F.split(F.expr(_HAVE), r"\|"), F.expr(_WANTED)), "|").alias("answers"))


_PROBLEM = R.case("doc_id % 8", "' Pick the mean of ' || doc_id", "'Write a Formula for [ANS] and [ANS], to the 90th percentile'", "'Find P_90 of the mean of ' || doc_id", "'Use software to find the p-value ' || doc_id", "'Select all of A. one B. two'", "'Count the apples [ANS] '", "'Which output list does the algorithm give?'", "'Find the standard deviation of ' || doc_id || ' [ANS]'")
_CHOICES = "CASE WHEN doc_id % 3 = 0 THEN ' one|two ' || doc_id ELSE '' END"
_ROUTED = rf"""
WITH q AS (SELECT doc_id, {_PROBLEM} AS q, CASE WHEN {_CHOICES} = '' THEN [] ELSE string_split({_CHOICES}, '|') END AS o FROM documents),
k AS (SELECT *, CASE WHEN len(o) > 0 THEN CASE WHEN regexp_matches(q, '(?i)\b(sequence|algorithm|output\s+list|oeis|recurrence|iteration|program)\b') THEN 'algorithm' ELSE 'none' END
  WHEN regexp_matches(q, '(?i)\b(formula|model|equation|quotient|composite|expression)\b') THEN 'formula' WHEN regexp_matches(q, '(?i)\bpercentile\b|\bP_?\d+\b') THEN 'percentile' WHEN regexp_matches(q, '(?i)\b(software|chi-?squared?|regression|correlation|p-?value)\b') THEN 'stats'
  WHEN regexp_matches(q, '(?i)\b(matching|match|select|which\s+of|choices?|options?)\b') THEN 'selection' ELSE 'none' END AS suffix, {R.count('q', '[ANS]')} AS blanks, array_to_string(list_transform(o, lambda x, i: chr(CAST(64 + i AS INTEGER)) || '. ' || trim(x)), chr(10)) AS lines FROM q),
c AS (SELECT *, CASE WHEN blanks = 1 THEN 'This problem has 1 [ANS] blank. Return exactly 1 answer.' WHEN blanks > 1 THEN 'This problem has ' || blanks || ' [ANS] blanks. Return exactly ' || blanks || ' answers.' ELSE 'No [ANS] marker appears. Return exactly one final answer.' END AS line,
  CASE suffix {' '.join(f"WHEN '{k}' THEN chr(10) || chr(10) || {R.text(v)}" for k, v in P.SUFFIXES.items())} ELSE '' END AS tail FROM k)
"""


def _routed(spark, d):
    options = F.when(F.expr(_CHOICES) == "", F.array().cast("array<string>")).otherwise(F.split(F.expr(_CHOICES), r"\|"))
    return table(spark, d, "documents").select("doc_id", F.expr(_PROBLEM).alias("q"), options.alias("o"))


@query("prompt_routing", _ROUTED + f"""
SELECT doc_id, suffix, lines AS options, greatest(CAST(1 AS BIGINT), blanks) AS expected, md5(CASE WHEN len(o) > 0 THEN {R.text(P.BASE)} || chr(10) || chr(10) || {R.text(P.MCQ)} || tail ELSE {R.text(P.BASE)} || chr(10) || chr(10) || line || chr(10) || chr(10) || {R.text(P.FREE)} || tail END) AS system_md5,
  CASE WHEN len(o) > 0 THEN trim(q) || chr(10) || chr(10) || 'Options:' || chr(10) || lines ELSE trim(q) END AS user_prompt FROM c""")
def prompt_routing(spark, d):
    q, o = F.col("q"), F.col("o")
    return _routed(spark, d).select("doc_id", P.suffix(q, o).alias("suffix"), X.option_lines(o).alias("options"), A.expected_answers(q).alias("expected"), F.md5(P.system(q, o).cast("binary")).alias("system_md5"), P.user(q, o).alias("user_prompt"))


def _fallback_sql(kind: str) -> str:
    mcq, free = (R.text(x) for x in P.FALLBACKS[kind])
    after = {"format": "chr(10) || chr(10) || 'Previous response:' || chr(10) || 'said ' || doc_id", "continuation": "chr(10) || chr(10) || 'Previous response tail:' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'id ' || doc_id ELSE 'said ' || doc_id END"}.get(kind, "''")
    return f"SELECT doc_id, '{kind}' AS kind, md5(CASE WHEN len(o) > 0 THEN {mcq} ELSE {free} {'' if kind == 'short' else '|| chr(10) || chr(10) || line'} END) AS system_md5, 'Problem:' || chr(10) || trim(q) || chr(10) || chr(10) || CASE WHEN len(o) > 0 THEN 'Options:' || chr(10) || lines ELSE 'Required number of answers: ' || greatest(1, blanks) END || {after} AS user_prompt FROM c"


@query("fallback_prompts", _ROUTED + " UNION ALL ".join(map(_fallback_sql, P.FALLBACKS)))
def fallback_prompts(spark, d):
    said, tail = F.concat(F.lit("said "), F.col("doc_id").cast("string"), F.lit(" ")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("id "), F.col("doc_id").cast("string"))).otherwise(" ")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), P.fallback(k, F.col("q"), F.col("o"), said, tail).alias("p")) for k in P.FALLBACKS))
    return _routed(spark, d).select("doc_id", F.explode(kinds).alias("k")).select("doc_id", "k.kind", F.md5(F.col("k.p.system").cast("binary")).alias("system_md5"), F.col("k.p.user").alias("user_prompt"))


@query("chat_rows", """
SELECT doc_id, '[{"role":"system","content":"Answer."},{"role":"user","content":"q' || doc_id || '"},{"role":"assistant","content":"' || n_chars || '"}]' AS messages FROM documents WHERE n_chars > 100""")
def chat_rows(spark, d):
    rows = table(spark, d, "documents").filter("n_chars > 100")
    return rows.select("doc_id", F.to_json(P.chat(F.lit("Answer."), F.concat(F.lit("q"), F.col("doc_id").cast("string")), F.col("n_chars").cast("string"))).alias("messages"))


_REASONS = "event_type || ',' || user_id || CASE WHEN event_id % 2 = 0 THEN ',third' ELSE '' END"
_CHOSEN = "event_id % 5 - 1"


@query("chosen_finish", f"SELECT event_id, coalesce(CASE WHEN {_CHOSEN} >= 0 THEN list_extract(r, {_CHOSEN} + 1) END, r[1], '') AS finish FROM (SELECT event_id, string_split({_REASONS}, ',') AS r FROM events)")
def chosen_finish(spark, d):
    return table(spark, d, "events").select("event_id", P.chosen_finish(F.split(F.expr(_REASONS), ","), F.expr(_CHOSEN).cast("int"), F.lit(None).cast("string")).alias("finish"))


@query("report_md", """
WITH r AS (SELECT lang, count(*) AS n, CAST(round(avg(n_chars)) AS BIGINT) AS avg_chars FROM documents GROUP BY lang)
SELECT '| lang | n | avg_chars |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || lang || ' | ' || n || ' | ' || avg_chars || ' |', chr(10) ORDER BY lang) AS report FROM r""")
def report_md(spark, d):
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars")).cast("long").alias("avg_chars"))
    return reporting.markdown_table(rows, ["lang"])


@query("html_index", """
WITH r AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT '<ul>' || string_agg('<li>' || '&lt;' || event_type || '&gt;: ' || n || '</li>', '' ORDER BY CASE event_type WHEN 'error' THEN 0 ELSE 1 END, '<' || event_type || '>') || '</ul>' AS html FROM r""")
def html_index(spark, d):
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("label", F.concat(F.lit("<"), "event_type", F.lit(">")))
    return reporting.html_index(rows, "label", "n", F.when(F.col("event_type") == "error", 0).otherwise(1))


@query("histogram", """
WITH p AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)
SELECT CAST(least(floor((least(greatest(value, lo), hi) - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM events, p GROUP BY 1""")
def histogram(spark, d):
    return reporting.histogram(table(spark, d, "events"), "value", 20)
