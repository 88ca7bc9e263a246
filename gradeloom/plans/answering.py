"""Answers with several letters or types, items with embedded options, self-checks, retries, best runs and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import corpus as C
from ..functions import prompts as P
from ..operators import grading as G
from ..operators import energy as E
from ..operators import joining as J
from ..operators import judging, repairing
from ..operators import scoring as S
from ..operators import splitting as P_
from ..operators.cutting import spread
from . import recipes as R
from .registry import query, table

_SEVERAL = f"{R.OWN} || " + R.case("doc_id % 7", R.box("' b c '"), R.box("'AG'"), "'Selected: ACE, done'", R.box("'two words'"), "'thus (d) it is'", f"'<think>' || {R.box("'A'")} || '</think> none here'", R.box("doc_id"))


@query("multi_letters", rf"""
WITH q AS (SELECT doc_id, {_SEVERAL} AS response, ['one', 'two words', 'three', 'four', 'five'] AS o FROM documents), t AS (SELECT *, {R.after_think('response')} AS tail FROM q),
i AS (SELECT *, CASE WHEN {R.last_box('tail')} <> '' THEN {R.last_box('tail')} ELSE {R.last_box('response')} END AS box, upper({R.last(r"regexp_extract_all(tail, '(?i)(?:answer\s+is|therefore|thus|hence|choose|selected|option|choice)\s*[:\s]*\(?([A-Z]+)\)?\b', 1)")}) AS said FROM t),
c AS (SELECT *, upper(regexp_replace(box, '\s+', '', 'g')) AS compact, list_position(o, trim(box)) AS place FROM i)
SELECT doc_id, CASE WHEN regexp_matches(compact, '^[A-E]+$') THEN compact WHEN place > 0 THEN chr(CAST(64 + place AS INTEGER)) WHEN regexp_matches(said, '^[A-E]+$') THEN said ELSE '' END AS letters FROM c""")
def multi_letters(spark, d):
    options = F.array(*map(F.lit, ("one", "two words", "three", "four", "five")))
    return table(spark, d, "documents").select("doc_id", A.letters(F.expr(_SEVERAL), options).alias("letters"))


_ITEM = {"question": R.case("doc_id % 5", "'Pick [ANS] A. one B. two ' || doc_id", "'Pick A. one B. two'", "'Sum of ' || doc_id", "'Pick A) x B) y C) z ' || doc_id", "'K. one L. two'"), "gold": R.case("doc_id % 4", "'A'", "'C'", "'b'", "'12'"), "options": "CASE WHEN doc_id % 3 = 0 THEN 'p|q' ELSE '' END"}


def _items(spark, d):
    options = F.when(F.expr(_ITEM["options"]) == "", F.array().cast("array<string>")).otherwise(F.split(F.expr(_ITEM["options"]), r"\|"))
    return table(spark, d, "documents").select("doc_id", F.expr(_ITEM["question"]).alias("q"), options.alias("o"), F.array(F.expr(_ITEM["gold"])).alias("g"))


_ITEMS_SQL = rf"""
WITH q AS (SELECT doc_id, {_ITEM['question']} AS q, {_ITEM['gold']} AS g, {_ITEM['options']} AS o FROM documents),
m AS (SELECT *, regexp_replace(q, '(^|[^A-Za-z0-9])([A-Z])[.)]\s+', '\1' || chr(1) || '\2' || chr(2), 'g') AS t FROM q),
e AS (SELECT *, regexp_matches(t, '\x01A\x02[^\x01]+\x01B\x02.') AS inline, list_transform(regexp_extract_all(t, '\x02([^\x01]*)', 1), lambda x: trim(x)) AS texts FROM m)
"""


@query("row_formats", _ITEMS_SQL + "SELECT doc_id, CASE WHEN o <> '' THEN 'mcq_options' WHEN inline AND regexp_matches(upper(g), '^[A-J]+$') THEN 'mcq_inline' ELSE 'free' END AS format FROM e")
def row_formats(spark, d):
    return _items(spark, d).select("doc_id", A.row_format(F.col("q"), F.col("o"), F.col("g")).alias("format"))


@query("normal_items", _ITEMS_SQL + ", n AS (SELECT *, o = '' AND inline AND regexp_matches(g, '^[A-Z]$') AND ord(g) - 65 < len(texts) AS moves FROM e) SELECT doc_id, CASE WHEN moves THEN trim(replace(split_part(t, chr(1), 1), '[ANS]', '')) ELSE q END AS question, CASE WHEN moves THEN array_to_string(texts, '|') ELSE o END AS options FROM n")
def normal_items(spark, d):
    return _items(spark, d).select("doc_id", C.normal_item(F.col("q"), F.col("o"), F.col("g")).alias("i")).select("doc_id", "i.question", F.array_join("i.options", "|").alias("options"))


_TYPED = "'{' || l_partkey || ', [1, 2' || ')' || ']}, ' || chr(92) || '(x, ' || l_suppkey || CASE WHEN l_linenumber % 2 = 0 THEN ', ' ELSE '' END"


@query("typed_split", rf"""
WITH q AS (SELECT l_orderkey, l_linenumber, {_TYPED} AS t FROM lineitem), h AS (SELECT *, regexp_extract(t, '^(\{{.*\}})', 1) AS first, regexp_replace(t, '^\{{.*\}},', '') AS rest FROM q)
SELECT l_orderkey, l_linenumber, array_to_string(list_filter(list_concat([first], list_transform(string_split(rest, ','), lambda x: trim(x))), lambda x: x <> ''), '|') AS items FROM h""")
def typed_split(spark, d):
    return spread(table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", F.array_join(judging.typed_split(F.expr(_TYPED)), "|").alias("items"))


_LISTED = R.box("p_partkey || ', -4'")
_LIST_GOLD = "'(' || (p_partkey + p_partkey % 2) || ', -4)'"


@query("free_score", rf"SELECT p_partkey, list_transform(string_split({R.last_box(_LISTED)}, ','), lambda x: trim(x)) = list_transform(string_split(trim({_LIST_GOLD}, '()'), ','), lambda x: trim(x)) AS ok FROM part")
def free_score(spark, d):
    return spread(table(spark, d, "part")).select("p_partkey", judging.free_scored(F.expr(_LISTED), F.array(F.expr(_LIST_GOLD))).alias("ok"))


_PAIR = {"boxed": R.case("p_partkey % 4", "p_partkey || '.0'", "'Paris'", "'AB' || chr(67)", "CAST(p_partkey AS STRING)"), "gold": R.case("p_partkey % 4", "CAST(p_partkey + p_partkey % 3 AS STRING)", "'PARIS'", "'CBA'", "CAST(p_partkey AS STRING)"), "type": R.case("p_partkey % 4", "'NV'", "'TXT'", "'MCM'", "CASE WHEN p_partkey % 8 = 3 THEN 'XX' ELSE 'NV' END")}


@query("typed_judge", f"""
WITH q AS (SELECT p_partkey, {R.last_box(R.box(_PAIR['boxed']))} AS a, {_PAIR['gold']} AS g, {_PAIR['type']} AS t FROM part)
SELECT p_partkey, CASE t WHEN 'NV' THEN g <> '0' AND CAST(a AS DOUBLE) = CAST(g AS DOUBLE) WHEN 'TXT' THEN lower(a) = lower(g) WHEN 'MCM' THEN list_sort(string_split(a, '')) = list_sort(string_split(g, '')) ELSE false END AS ok FROM q""")
def typed_judge(spark, d):
    # A gold answer of "0" reads as False, as scores depend on, so no number matches it.
    return spread(table(spark, d, "part")).select("p_partkey", judging.typed_judged(F.expr(R.box(_PAIR["boxed"])), F.array(F.expr(_PAIR["gold"])), F.array(F.expr(_PAIR["type"]))).alias("ok"))


_CANDIDATE = R.case("p_partkey % 3", "p_partkey || '/4'", "' ' || p_partkey || ' '", "'none of them'")
_VALUES = "CAST(p_partkey / 2 AS STRING) || '|' || CAST(p_partkey / 4 AS STRING) || '|' || p_partkey"


@query("option_by_value", f"""
WITH q AS (SELECT p_partkey, trim({_CANDIDATE}) AS c, list_transform(string_split({_VALUES}, '|'), lambda x: CAST(x AS DOUBLE)) AS v FROM part),
n AS (SELECT *, TRY_CAST(split_part(c, '/', 1) AS DOUBLE) / CASE WHEN contains(c, '/') THEN 4 ELSE 1 END AS x FROM q)
SELECT p_partkey, CAST(coalesce(list_position(list_transform(v, lambda y: abs(y - x) <= 1e-8 * abs(y)), true), 0) AS INTEGER) AS number FROM n""")
def option_by_value(spark, d):
    return spread(table(spark, d, "part")).select("p_partkey", judging.option_of(F.expr(_CANDIDATE), F.split(F.expr(_VALUES), r"\|")).alias("number"))


_OWN_GOLD = R.case("o_orderkey % 4", "CAST(o_orderkey AS STRING)", "'1, ' || o_orderkey", "'(1, ' || o_orderkey || ')'", "'x+' || o_orderkey")


@query("self_check", f"SELECT o_orderkey, CASE WHEN len({R.split(_OWN_GOLD)}) <> 1 THEN 'judge_count_mismatch' ELSE '' END AS flags FROM orders")
def self_check(spark, d):
    return spread(table(spark, d, "orders")).select("o_orderkey", F.array_join(judging.self_check(F.array(F.expr(_OWN_GOLD)), F.lit("")), "|").alias("flags"))


_REPLY = {"error": R.case("o_orderkey % 5", "'correct'", "'truncated'", "'no_answer'", "'wrong'", "'count_mismatch'"), "reply_error": R.case("o_orderkey % 3", "'correct'", "'truncated'", "'wrong'")}


@query("retried_once", f"""
WITH q AS (SELECT o_orderkey AS id, {_REPLY['error']} AS e, {_REPLY['reply_error']} AS r FROM orders), u AS (SELECT *, e IN ('truncated', 'no_answer', 'count_mismatch') AND id % 7 <> 0 AND r <> 'truncated' AS used FROM q)
SELECT id, CASE WHEN used THEN 'again ' || id ELSE 'first ' || id END AS response, CASE WHEN used THEN r ELSE e END AS error_type, used AS fallback_used FROM u""")
def retried_once(spark, d):
    orders = table(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
    said = lambda word: F.concat(F.lit(f"{word} "), F.col("id").cast("string"))
    rows = orders.select("id", said("first").alias("response"), F.expr(_REPLY["error"]).alias("error_type"))
    replies = orders.filter("id % 7 <> 0").select("id", said("again").alias("response"), F.expr(_REPLY["reply_error"]).alias("error_type"))
    return repairing.retried_once(rows, replies, "id", ["response"])


@query("best_combination", """
WITH r AS (SELECT lang AS type, source AS prompt, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS correct FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY type ORDER BY correct / CAST(n AS DOUBLE) DESC, prompt) = 1), u AS (SELECT * FROM b UNION ALL SELECT NULL, NULL, sum(n), sum(correct) FROM b)
SELECT type, prompt, CAST(n AS BIGINT) AS n, CAST(correct AS BIGINT) AS correct, round(correct / CAST(n AS DOUBLE), 6) AS accuracy FROM u""")
def best_combination(spark, d):
    joined = table(spark, d, "documents").select("doc_id", F.col("lang").alias("type"), F.col("source").alias("prompt")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    runs = joined.groupBy("type", "prompt").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("correct"))
    return S.best_combination(runs, "type", ["prompt"])


@query("planned_stages", """
WITH s(position, stage) AS (VALUES (0, 'train'), (1, 'merge'), (2, 'eval_dev'), (3, 'score_dev'), (4, 'eval_holdout'), (5, 'score_holdout'))
SELECT DISTINCT p_brand AS experiment, CAST(position AS INTEGER) AS position, stage FROM part, s""")
def planned_stages(spark, d):
    return S.planned(table(spark, d, "part").select(F.col("p_brand").alias("experiment")).distinct(), "experiment", ["dev", "holdout"])


_AUDITED = {"role": "CASE WHEN doc_id % 11 = 0 THEN 'user' ELSE 'system' END", "assistant": f"CASE WHEN doc_id % 2 = 0 THEN '<think>' || text || '</think>' ELSE 'short words ' END || {R.case('doc_id % 4', R.box('doc_id'), R.box("'1, ' || doc_id"), "'none'", R.box("'x+' || doc_id"))}"}


@query("corpus_audit", rf"""
WITH q AS (SELECT {_AUDITED['role']} = 'system' AS fine, {_AUDITED['assistant']} AS a FROM documents), b AS (SELECT *, {R.last_box('a')} AS box, CAST(len(regexp_extract_all(CASE WHEN contains(a, '<think>') THEN split_part(split_part(a, '<think>', 2), '</think>', 1) ELSE a END, '\S+')) AS BIGINT) AS words FROM q)
SELECT count(*) AS rows, count(*) FILTER (WHERE NOT fine) AS bad_schema, count(*) FILTER (WHERE fine AND (box = '' OR contains(box, ','))) AS oracle_fail, round(coalesce(sum(words) FILTER (WHERE fine), 0) / CAST(count(*) AS DOUBLE), 2) AS avg_reasoning_words, coalesce(max(words) FILTER (WHERE fine), 0) AS max_reasoning_words FROM b""")
def corpus_audit(spark, d):
    say = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    messages = F.array(say(F.expr(_AUDITED["role"]), F.lit("s")), say(F.lit("user"), F.lit("q")), say(F.lit("assistant"), F.expr(_AUDITED["assistant"])))
    rows = table(spark, d, "documents").select(messages.alias("m"))
    answer = A.last_box(P.last_assistant(F.col("m")))
    accepted = judging.judged(F.concat(F.lit("FINAL_ANSWERS:\n\\boxed{"), answer, F.lit("}")), F.array(answer))
    return rows.agg(*(c.alias(k) for k, c in C.corpus_audit(F.col("m"), accepted).items()))


_REWARDED = {"response": R.case("p_partkey % 5", R.box("p_partkey || '.50'"), R.box("'A'"), R.box("p_partkey || 'x^2'"), "'none'", R.box("p_partkey")), "gold": R.case("p_partkey % 5", "p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.5' ELSE '.6' END", "CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END", "p_partkey || 'x^{2}'", "'1'", "''")}


@query("correctness_reward", f"""
WITH q AS (SELECT p_partkey, {R.last_box('response')} AS box, gold FROM (SELECT p_partkey, {_REWARDED['response']} AS response, {_REWARDED['gold']} AS gold FROM part))
SELECT p_partkey, CAST(CASE WHEN gold = '' OR box = '' THEN 0 WHEN regexp_matches(gold, '^[A-Z]$') THEN CASE WHEN box = gold THEN 1 ELSE 0 END WHEN contains(box, 'x') THEN CASE WHEN replace(replace(gold, '{{', ''), '}}', '') = box THEN 1 ELSE 0 END ELSE CASE WHEN CAST(box AS DOUBLE) = CAST(gold AS DOUBLE) THEN 1 ELSE 0 END END AS DOUBLE) AS reward FROM q""")
def correctness_reward(spark, d):
    question = F.when(F.col("p_partkey") % 5 == 1, "Pick A. one B. two").otherwise("Find it")
    rows = table(spark, d, "part").select("p_partkey", G.correctness(F.expr(_REWARDED["response"]), question, F.array().cast("array<string>"), F.array(F.expr(_REWARDED["gold"]))).alias("reward"))
    return rows


_CHOICE = {"response": R.case("doc_id % 4", "'The answer is b.'", R.box("'c'"), R.box("doc_id"), "'no idea'"), "gold": R.case("doc_id % 3", "'B'", "'C'", "CAST(doc_id AS STRING)")}


@query("scored_rows", rf"""
WITH q AS (SELECT doc_id, {_CHOICE['response']} AS r, {_CHOICE['gold']} AS g FROM documents),
l AS (SELECT *, {R.last_box('r')} AS box, CASE WHEN regexp_matches({R.last_box('r')}, '^[a-z]$') THEN upper({R.last_box('r')}) WHEN regexp_matches(r, 'is b') THEN 'B' ELSE '' END AS letter FROM q)
SELECT doc_id, CASE WHEN regexp_matches(g, '^[A-Z]$') AND letter <> '' THEN letter = g WHEN contains(r, 'is b') THEN lower(g) = 'b' ELSE box = g AND g NOT IN ('0', '1') OR (box = g AND g IN ('0', '1')) END AS ok FROM l""")
def scored_rows(spark, d):
    options = F.array(*map(F.lit, ("p", "q", "r")))
    rows = table(spark, d, "documents").select("doc_id", F.expr(_CHOICE["response"]).alias("r"), F.array(F.expr(_CHOICE["gold"])).alias("g"))
    return rows.select("doc_id", judging.scored(F.col("r"), F.col("g"), options, A.letters(F.col("r"), options)).alias("ok"))


@query("ordered_runs", """
WITH r AS (SELECT lang AS type, source AS config, count(*) AS n, avg(CAST(quality AS DOUBLE)) AS acc FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
SELECT type, config, n, round(acc, 6) AS accuracy, row_number() OVER (ORDER BY type, acc DESC, config) AS place FROM r""")
def ordered_runs(spark, d):
    from pyspark.sql import Window

    joined = table(spark, d, "documents").select("doc_id", F.col("lang").alias("type"), F.col("source").alias("config")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    runs = joined.groupBy("type", "config").agg(F.count("*").alias("n"), F.avg("quality").alias("acc"))
    place = F.row_number().over(Window.orderBy("type", F.desc("acc"), "config")).cast("long")  # one row a run
    return runs.select("type", "config", "n", F.round("acc", 6).alias("accuracy"), place.alias("place"))


@query("expected_with_gold", f"""
WITH q AS (SELECT doc_id, {R.count(f"({_ITEM['question']})", '[ANS]')} AS blanks, string_split(CASE WHEN doc_id % 2 = 0 THEN '1|2|' ELSE '' END, '|') AS g FROM documents)
SELECT doc_id, CASE WHEN blanks > 0 THEN blanks ELSE greatest(CAST(1 AS BIGINT), CAST(len(list_filter(g, lambda x: x <> '')) AS BIGINT)) END AS expected FROM q""")
def expected_with_gold(spark, d):
    gold = F.split(F.when(F.col("doc_id") % 2 == 0, "1|2|").otherwise(""), r"\|")
    return table(spark, d, "documents").select("doc_id", A.expected_answers(F.expr(_ITEM["question"]), gold).alias("expected"))


@query("merged_sources", """
WITH u AS (SELECT o_orderkey AS id, o_orderstatus AS response, 'base' AS source, 0 AS p FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_orderpriority, 'other', 1 FROM orders WHERE o_orderkey % 2 = 0)
SELECT id, response, source, -id AS position FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) = 1""")
def merged_sources(spark, d):
    orders = table(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
    base = orders.filter("id % 3 <> 0").select("id", F.col("o_orderstatus").alias("response"))
    other = orders.filter("id % 2 = 0").select("id", F.col("o_orderpriority").alias("response"))
    return J.merged(orders.select("id", (-F.col("id")).alias("position")), "id", base=base, other=other)


@query("first_shuffled", """
WITH f AS (SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 50)
SELECT doc_id, lang, row_number() OVER (ORDER BY md5('5:' || doc_id), doc_id) AS position FROM f""")
def first_shuffled(spark, d):
    # The first fifty rows in file order are the operator's own limit.
    return P_.first_rows(table(spark, d, "documents").filter("lang = 'en'").select("doc_id", "lang"), ["doc_id"], "doc_id", 50, 5)


@query("component_watts", "SELECT user_id, round(avg(value), 4) AS watts, round(avg(value) FILTER (WHERE event_type = 'click'), 4) AS watts_click, round(avg(value) FILTER (WHERE event_type = 'view'), 4) AS watts_view FROM events GROUP BY user_id")
def component_watts(spark, d):
    return E.components(table(spark, d, "events"), "user_id", "event_type", "value", ["click", "view"])
