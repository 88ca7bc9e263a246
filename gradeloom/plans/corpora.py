"""Corpus filters, answer style and diagnoses over responses put together from columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import corpus as C
from ..functions import prompts as P
from ..functions import style as S
from ..operators import diagnosing as D
from . import recipes as R
from .registry import query, table


_EXPRESSION = R.case("p_partkey % 7", "chr(92) || 'frac{' || p_partkey || '}{' || (p_partkey + 1) || '}'", "p_partkey || 'x^2 + ' || p_partkey", "chr(92) || 'sin^2(x) + ' || p_partkey", "' ' || chr(92) || 'sqrt{' || p_partkey || '} '", "p_partkey || 'e^{kt}'", "'origin'", "p_partkey || '(x+' || p_partkey || ')(x - 2)'")
_STYLE_SQL = r"""
WITH q AS (SELECT p_partkey, {recipe} AS a FROM part),
p AS (SELECT p_partkey, regexp_replace(regexp_replace(trim(a), '\\frac\{{([^{{}}]+)\}}\{{([^{{}}]+)\}}', '(\1)/(\2)', 'g'), '\\sqrt\{{([^{{}}]+)\}}', 'sqrt(\1)', 'g') AS a FROM q),
w AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(a, '\\?(sin)\^(\d)\(([^()]*)\)', '\1(\3)**\2'), '\^\{{([a-z])([a-z])\}}', '**(\1*\2)'), '\^(\d+)', '**(\1)') AS a FROM p),
m AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(a, '(\d)([a-z(])', '\1*\2', 'g'), '\)\(', ')*(', 'g'), '\s*([-+=/,])\s*', '\1', 'g') AS a FROM w)
"""


@query("expression_style", _STYLE_SQL.format(recipe=_EXPRESSION) + "SELECT p_partkey, a AS styled FROM m")
def expression_style(spark, d):
    return table(spark, d, "part").select("p_partkey", S.expression_style(F.expr(_EXPRESSION), F.lit("")).alias("styled"))


_FIRST, _SECOND = "CASE WHEN p_partkey % 2 = 0 THEN 'Answer: ' ELSE 'ans = ' END || p_partkey || '.'", "CASE WHEN p_partkey % 3 = 0 THEN chr(92) || 'boxed{' || chr(92) || 'sqrt{' || p_partkey || '}}' ELSE chr(92) || 'dfrac{1}{' || p_partkey || '}' END"


@query("final_response", rf"""
WITH q AS (SELECT p_partkey, {_FIRST} AS one, {_SECOND} AS two FROM part),
c AS (SELECT p_partkey, regexp_replace(regexp_replace(one, '(?i)^(?:answer|ans)\s*[:=]\s*', ''), '\.$', '') AS one, regexp_replace(regexp_replace(two, '^\\boxed\{{(.*)\}}$', '\1'), '\\dfrac\{{(\d+)\}}\{{(\d+)\}}', '(\1)/(\2)') AS two FROM q)
SELECT p_partkey, 'FINAL_ANSWERS:' || chr(10) || '\boxed{{' || one || ', ' || two || '}}' AS response FROM c""")
def final_response(spark, d):
    return table(spark, d, "part").select("p_partkey", S.final_response(F.array(F.expr(_FIRST), F.expr(_SECOND)), F.lit("")).alias("response"))


#: A chat row: what the user asks, and the answer, after reasoning of some length.
_CHAT_USER = R.case("doc_id % 5", "'Find it'", "'Options: a, b'", "'Pick A. one B. two'", "'Find x'", "'What is ' || doc_id")
_CHAT_ANSWER = R.case("doc_id % 9", "CAST(doc_id AS STRING)", "'C'", "'3,4'", "'five'", "' '", "'2/' || doc_id", "'12 cm'", "chr(92) || 'sqrt{' || doc_id || '}'", "'x=' || doc_id")
_CHAT = f"'<think>' || CASE WHEN doc_id % 2 = 0 THEN text ELSE 'short' END || '</think>FINAL_ANSWERS: ' || {R.box(_CHAT_ANSWER)}"


@query("usable_rows", rf"""
WITH q AS (SELECT doc_id, {_CHAT_USER} AS u, {_CHAT} AS a FROM documents), b AS (SELECT *, {R.last_box("split_part(a, 'FINAL_ANSWERS', 2)")} AS box, len(regexp_extract_all(split_part(split_part(a, '<think>', 2), '</think>', 1), '\S+')) AS words FROM q)
SELECT doc_id FROM b WHERE NOT regexp_matches(u, '(?is)options:|(^|[^A-Za-z0-9])A[.)]\s.*[^A-Za-z0-9]B[.)]\s') AND box <> '' AND NOT regexp_matches(box, '(?i)^[A-J]$') AND words <= 700
  AND NOT regexp_matches(box, '[,$:=%]') AND NOT regexp_matches(lower(box), '\b(cm|inch|inches|feet|meters?|hours?)\b') AND len(list_filter(regexp_extract_all(regexp_replace(box, '\\[A-Za-z]', '', 'g'), '[A-Za-z]{{2,}}'), lambda x: NOT list_contains(['sqrt', 'frac', 'sin', 'cos', 'tan', 'log', 'ln', 'pi', 'arcsin', 'arccos', 'arctan'], x))) = 0""")
def usable_rows(spark, d):
    return table(spark, d, "documents").filter(C.usable(P.chat(F.lit("s"), F.expr(_CHAT_USER), F.expr(_CHAT)))).select("doc_id")


_LABELLED = {"question": "repeat('[ANS] ', CAST(doc_id % 3 AS INT)) || 'what'", "answers": R.case("doc_id % 6", "'1'", "'1|2'", "'B'", "''", "'b|'", "substring(text, 1, 300)"), "options": "CASE WHEN doc_id % 4 = 0 THEN 'x|y' ELSE '' END"}


@query("high_confidence", rf"""
WITH q AS (SELECT doc_id, {R.count(f"({_LABELLED['question']})", '[ANS]')} AS blanks, string_split({_LABELLED['answers']}, '|') AS a, {_LABELLED['options']} <> '' AS has FROM documents)
SELECT doc_id FROM q WHERE NOT list_contains(a, '') AND CASE WHEN has THEN len(a) = 1 AND regexp_matches(a[1], '^[A-Z]+$') ELSE (blanks = 0 OR len(a) = blanks) AND len(list_filter(a, lambda x: length(x) > 240 OR contains(x, chr(10)))) = 0 END""")
def high_confidence(spark, d):
    parts = {k: F.split(F.expr(v), r"\|") if k == "answers" else F.expr(v) for k, v in _LABELLED.items()}
    options = F.when(parts["options"] == "", F.array().cast("array<string>")).otherwise(F.split(parts["options"], r"\|"))
    return table(spark, d, "documents").filter(C.high_confidence(parts["question"], parts["answers"], options)).select("doc_id")


_SOLUTION = R.case("doc_id % 6", "'Add. Therefore, the sum of it is ' || doc_id", "'We see the answer is:' || chr(10) || ' $' || doc_id", "'nothing: here; at all!'", "text || ' So, x = ' || doc_id || ' cm'", "'Therefore this is good; so it is ' || doc_id", "'the answer is ' || repeat('9', 60 + CAST(doc_id % 40 AS INT))")


@query("announced_final", rf"""
WITH q AS (SELECT doc_id, {_SOLUTION} AS s FROM documents),
f AS (SELECT doc_id, [regexp_extract(s, '(?is)Therefore,?\s+.*?(?:is|=)\s*:?\s*([$\\\w.,/+() -]+)$', 1), regexp_extract(s, '(?is)So,?\s+.*?(?:is|=)\s*:?\s*([$\\\w.,/+() -]+)$', 1), regexp_extract(s, '(?is)answer is\s*:?\s*([$\\\w.,/+() -]+)$', 1)] AS found FROM q)
SELECT doc_id, list_filter(list_transform(found, lambda x: trim(x)), lambda x: x <> '' AND length(x) <= 80)[1] AS final FROM f""")
def announced_final(spark, d):
    return table(spark, d, "documents").select("doc_id", C.announced_final(F.expr(_SOLUTION)).alias("final"))


_WORKED = f"{R.OWN} || 'Add ' || doc_id || ' and' || chr(13) || chr(10) || '2 to get ' || {R.box("'x^{' || doc_id || '}'")} || '.' || CASE doc_id % 3 WHEN 0 THEN ' Therefore the total is (x) ' || doc_id || '.' WHEN 1 THEN ' It is nice.' ELSE '' END || chr(10) || '#### ' || doc_id"


@query("solution_reasoning", rf"""
WITH q AS (SELECT doc_id, {_WORKED} AS s FROM documents), l AS (SELECT doc_id, trim(regexp_replace(regexp_replace(split_part(s, '####', 1), '{R.BOX}', '\1', 'g'), '\s+', ' ', 'g')) AS s FROM q)
SELECT doc_id, trim(regexp_replace(s, '(?i)(?:therefore|thus|so)[^.]*' || doc_id || '[^.]*\.?\s*$', '')) AS reasoning FROM l""")
def solution_reasoning(spark, d):
    return table(spark, d, "documents").select("doc_id", C.solution_reasoning(F.expr(_WORKED), F.col("doc_id").cast("string")).alias("reasoning"))


@query("inline_options", r"""
WITH q AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Pick [ANS] A. one B. two ' || doc_id || ' C) three' WHEN 1 THEN 'Pick A) x' || doc_id || ' B) y D) z' WHEN 2 THEN 'Pick A. only C. this A. p B. q ' || doc_id WHEN 3 THEN 'xA. no ' || doc_id ELSE 'A. lone ' || doc_id END AS q FROM documents),
m AS (SELECT doc_id, q, regexp_replace(q, '(^|[^A-Za-z0-9])([A-Z])[.)]\s+', '\1' || chr(1) || '\2' || chr(2), 'g') AS t FROM q),
c AS (SELECT doc_id, regexp_extract(t, '^(.*?)\x01A\x02[^\x01]*\x01B\x02', 1) AS stem, regexp_extract(t, '\x01A\x02([^\x01]*)\x01B\x02', 1) AS a, regexp_extract(t, '\x01A\x02[^\x01]*\x01B\x02(.*)$', 1) AS rest FROM m),
o AS (SELECT doc_id, replace(regexp_replace(stem, '\x01([A-Z])\x02', '\1. ', 'g'), '[ANS]', '') AS stem, rest, CASE WHEN rest = '' THEN '' WHEN contains(rest, chr(1) || 'C' || chr(2)) THEN trim(a) || '|' || trim(split_part(rest, chr(1), 1)) || '|' || trim(split_part(rest, chr(2), 2)) ELSE trim(a) || '|' || trim(regexp_replace(rest, '\x01([A-Z])\x02', '\1) ', 'g')) END AS options FROM c)
SELECT doc_id, options, CASE WHEN rest <> '' THEN trim(stem) END AS stem FROM o""")
def inline_options(spark, d):
    k, n = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    question = F.when(k == 0, F.concat(F.lit("Pick [ANS] A. one B. two "), n, F.lit(" C) three"))).when(k == 1, F.concat(F.lit("Pick A) x"), n, F.lit(" B) y D) z"))).when(k == 2, F.concat(F.lit("Pick A. only C. this A. p B. q "), n)).when(k == 3, F.concat(F.lit("xA. no "), n)).otherwise(F.concat(F.lit("A. lone "), n))
    q = table(spark, d, "documents").select("doc_id", question.alias("q"))
    return q.select("doc_id", F.array_join(C.inline_options(F.col("q")), "|").alias("options"), C.stem(F.col("q")).alias("stem"))


_WRONG = {"finish": "CASE WHEN doc_id % 17 = 0 THEN 'length' ELSE 'stop' END", "choice": "doc_id % 10 = 2", "gold": R.case("doc_id % 10", "'12'", "CAST(doc_id AS STRING)", "'A'", "'1|Cat'", "doc_id || '.1416'", "chr(92) || 'frac{' || doc_id || '}{2}'", "'Paert'", "chr(92) || 'pi'", "'2|3.1416'", "'12'"), "found": R.case("doc_id % 10", "'12.01'", "''", "'B'", "'1'", "doc_id || '.14'", "'frac{' || doc_id || '}{ 2 }'", "'paert '", "'3.14'", "'2|3.142'", "'99'")}


@query("wrong_answers", rf"""
WITH q AS (SELECT {_WRONG['finish']} AS finish, {_WRONG['choice']} AS choice, string_split({_WRONG['gold']}, '|') AS g, string_split({_WRONG['found']}, '|') AS p FROM documents),
k AS (SELECT *, list_filter(list_transform(list_zip(g, p), lambda z: CASE WHEN trim(z[1]) = trim(z[2]) THEN 'same' WHEN TRY_CAST(z[1] AS DOUBLE) IS NOT NULL AND abs(TRY_CAST(z[1] AS DOUBLE) - TRY_CAST(z[2] AS DOUBLE)) < 5e-3 * greatest(abs(TRY_CAST(z[1] AS DOUBLE)), abs(TRY_CAST(z[2] AS DOUBLE))) THEN 'rounding'
    WHEN replace(replace(lower(trim(z[1])), '\frac', 'frac'), ' ', '') = replace(replace(lower(trim(z[2])), '\frac', 'frac'), ' ', '') THEN 'notation' ELSE 'real' END), lambda x: x <> 'same') AS kinds FROM q),
w AS (SELECT CASE WHEN finish = 'length' THEN 'truncated' WHEN array_to_string(p, '') = '' THEN 'empty-extracted' WHEN choice THEN CASE WHEN upper(g[1]) <> upper(p[1]) THEN 'mcq-letter-disagree' ELSE 'real-error' END
    WHEN len(g) <> len(p) THEN 'multi-blank-misaligned' WHEN len(g) > 1 THEN CASE WHEN len(kinds) > 0 AND NOT list_has_any(kinds, ['notation', 'real']) THEN 'rounding' WHEN len(kinds) > 0 AND NOT list_contains(kinds, 'real') THEN 'notation' ELSE 'real-error' END
    WHEN kinds = ['rounding'] THEN 'rounding' WHEN TRY_CAST(g[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(p[1] AS DOUBLE) IS NOT NULL THEN 'real-error' WHEN kinds = ['notation'] THEN 'notation' WHEN TRY_CAST(p[1] AS DOUBLE) IS NOT NULL THEN 'symbolic-vs-decimal' ELSE 'real-error' END AS kind FROM k)
SELECT kind, count(*) AS n FROM w GROUP BY 1""")
def wrong_answers(spark, d):
    kind = D.wrong_answer(F.expr(_WRONG["finish"]), F.expr(_WRONG["choice"]), F.split(F.expr(_WRONG["gold"]), r"\|"), F.split(F.expr(_WRONG["found"]), r"\|"))
    return table(spark, d, "documents").select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_RUN = "lower(replace(substring(o_orderpriority, 3), ' ', '_')) || CASE o_orderkey % 5 WHEN 0 THEN '_train' WHEN 1 THEN '_dev' WHEN 2 THEN '_validation_holdout' WHEN 3 THEN '_holdout' ELSE '' END"
_RUN_NAME = f"CASE o_orderkey % 3 WHEN 0 THEN 'lora_' WHEN 1 THEN 'base-' ELSE 'x' END || {_RUN}"


@query("run_dimensions", rf"""
WITH q AS (SELECT o_orderpriority AS name, {_RUN_NAME} AS run FROM orders)
SELECT name, regexp_extract(run, '^(lora|base)', 1) || CASE WHEN regexp_matches(run, '^(lora|base)') THEN '' ELSE 'other' END AS model, CASE regexp_extract(run, '(train|dev|validation)', 1) WHEN 'train' THEN 'train' WHEN 'dev' THEN 'validation' WHEN 'validation' THEN 'validation' ELSE CASE WHEN contains(run, 'holdout') THEN 'holdout' ELSE 'other' END END AS split, count(*) AS n FROM q GROUP BY ALL""")
def run_dimensions(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), D.run_model(F.expr(_RUN_NAME)).alias("model"), D.run_split(F.expr(_RUN_NAME)).alias("split")).groupBy("name", "model", "split").agg(F.count("*").alias("n"))


_TENSOR = f"'model.layers.' || vec_id || '.' || {R.case('(vec_id + label) % 9', *(f"'{m}'" for m in ('q_proj', 'k_proj', 'v_proj', 'o_proj', 'gate_proj', 'up_proj', 'down_proj', 'norm', 'embed')))} || '.lora_' || CASE vec_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END || '.weight'"


@query("tensor_names", rf"""
WITH q AS (SELECT {_TENSOR} AS k FROM embeddings)
SELECT CASE WHEN regexp_matches(k, '\.[qkvo]_proj\.') THEN 'attention' WHEN regexp_matches(k, '\.(gate|up|down)_proj\.') THEN 'mlp' ELSE 'other' END AS family, regexp_extract(k, '\.lora_([AB])\.', 1) AS side, count(*) AS n FROM q GROUP BY ALL""")
def tensor_names(spark, d):
    key = F.expr(_TENSOR)
    return table(spark, d, "embeddings").select(D.tensor_family(D.tensor_module(key)).alias("family"), D.tensor_side(key).alias("side")).groupBy("family", "side").agg(F.count("*").alias("n"))


_MERGED = {"response": R.case("doc_id % 7", "' '", "'text'", R.box("'1, 2'"), R.box("doc_id"), "'none'", "chr(10)", R.box("'(1,2),3'")), "options": "CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 0 END", "letter": "CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'B' END", "expected": "1 + doc_id % 2"}


@query("run_inspection", rf"""
WITH q AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _MERGED.items())} FROM documents), b AS (SELECT *, {R.last_box('response')} AS box FROM q),
i AS (SELECT CASE WHEN trim(response, {R.SPACES}) = '' THEN 'empty' WHEN options > 0 THEN CASE WHEN letter = '' THEN 'options_no_letter' END WHEN box = '' THEN 'no_options_no_extract' WHEN len({R.split('box')}) <> expected THEN 'no_options_count_mismatch' END AS issue FROM b)
SELECT count(*) FILTER (issue = 'empty') AS empty, count(*) FILTER (issue = 'options_no_letter') AS options_no_letter, count(*) FILTER (issue = 'no_options_no_extract') AS no_options_no_extract, count(*) FILTER (issue = 'no_options_count_mismatch') AS no_options_count_mismatch FROM i""")
def run_inspection(spark, d):
    v = {k: F.expr(e) for k, e in _MERGED.items()}
    found = A.last_box(v["response"])
    parts = F.when(found == "", 0).otherwise(F.size(A.top_level_split(found)))
    return D.inspected(table(spark, d, "documents"), v["response"], v["options"], v["letter"], parts, v["expected"])
