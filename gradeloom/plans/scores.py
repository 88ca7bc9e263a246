"""Scores, rollups, joins and reconciliations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import joining as J
from ..operators import scoring as S
from .registry import query, table


@query("score_summary", """
SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS correct, round(coalesce(count(*) FILTER (WHERE quality = 1) / CAST(nullif(count(*), 0) AS DOUBLE), 0), 6) AS accuracy,
  count(*) FILTER (WHERE lang = 'en') AS mcq_total, count(*) FILTER (WHERE lang = 'en' AND quality = 1) AS mcq_correct, round(coalesce(count(*) FILTER (WHERE lang = 'en' AND quality = 1) / CAST(nullif(count(*) FILTER (WHERE lang = 'en'), 0) AS DOUBLE), 0), 6) AS mcq_accuracy,
  count(*) FILTER (WHERE lang <> 'en') AS free_total, count(*) FILTER (WHERE lang <> 'en' AND quality = 1) AS free_correct, round(coalesce(count(*) FILTER (WHERE lang <> 'en' AND quality = 1) / CAST(nullif(count(*) FILTER (WHERE lang <> 'en'), 0) AS DOUBLE), 0), 6) AS free_accuracy
FROM labels JOIN documents USING (doc_id)""")
def score_summary(spark, d):
    scored = J.require(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return S.accuracy(scored, F.col("quality") == 1, F.col("lang") == "en")


@query("grade_rollup", """
SELECT lang, CAST(grouping(lang) AS INTEGER) AS is_total, count(*) AS n, round(avg(n_chars), 4) AS avg_chars FROM documents GROUP BY ROLLUP (lang)""")
def grade_rollup(spark, d):
    return S.rolled_up(table(spark, d, "documents"), "lang", F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("avg_chars"))


@query("grouping_sets_report", """
SELECT lang, source, count(*) AS n, round(avg(n_chars), 4) AS avg_chars FROM documents GROUP BY GROUPING SETS ((), (lang), (source))""")
def grouping_sets_report(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("avg_chars"))


@query("error_pivot", """
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'signup') AS n_signup, count(*) FILTER (WHERE event_type = 'error') AS n_error, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase FROM events GROUP BY user_id""")
def error_pivot(spark, d):
    return S.pivoted(table(spark, d, "events"), "user_id", "event_type", ["signup", "error", "click", "view", "purchase"])


@query("format_diagnostics", """
SELECT count(*) AS turns, count(*) FILTER (WHERE trim(text) = '') AS empty_turns, count(*) FILTER (WHERE length(text) < 40) AS short_turns, count(*) FILTER (WHERE length(text) > 400) AS long_turns, count(*) FILTER (WHERE role NOT IN ('system', 'user', 'assistant')) AS odd_roles,
  count(*) FILTER (WHERE role = 'assistant') AS answers, count(*) FILTER (WHERE role = 'assistant' AND length(text) < 40) AS short_answers, round(avg(length(text)), 4) AS avg_chars, CAST(max(length(text)) AS BIGINT) AS max_chars FROM conversations""")
def format_diagnostics(spark, d):
    n, role = F.length("text"), F.col("role")
    tests = {"empty_turns": F.trim("text") == "", "short_turns": n < 40, "long_turns": n > 400, "odd_roles": ~role.isin("system", "user", "assistant"), "answers": role == "assistant", "short_answers": (role == "assistant") & (n < 40)}
    return table(spark, d, "conversations").agg(F.count("*").alias("turns"), *(F.count_if(t).alias(k) for k, t in tests.items()), F.round(F.avg(n), 4).alias("avg_chars"), F.max(n).cast("long").alias("max_chars"))


@query("transition_matrix", """
WITH g(name, q, t) AS (VALUES ('both_correct', 1, 1), ('lost', 1, 0), ('gained', 0, 1), ('both_wrong', 0, 0))
SELECT name AS "group", count(labels.doc_id) AS count FROM g LEFT JOIN labels ON quality = q AND toxic = t GROUP BY name""")
def transition_matrix(spark, d):
    return S.transitions(table(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


@query("left_join_missing", "SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), 'unlabelled') AS grade FROM documents d LEFT JOIN labels USING (doc_id)")
def left_join_missing(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("unlabelled")).alias("grade"))


@query("semi_join_scored", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_scored(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("anti_join_unlabelled", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_unlabelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("decontam_exact", """
WITH c AS (SELECT doc_id, trim(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents),
b AS (SELECT trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM benchmark
      UNION SELECT trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n FROM c WHERE t NOT IN (SELECT t FROM b)""")
def decontam_exact(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("t"))
    held = table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    evaluation = table(spark, d, "benchmark").select(X.clean_text(F.col("text")).alias("t")).unionByName(docs.join(held, "doc_id", "left_semi").select("t"))
    return J.without(docs, "t", evaluation).select("doc_id", F.length("t").cast("long").alias("n"))


@query("decontam_contains", """
WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' ' AS t FROM documents),
b AS (SELECT item_id, ' ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' ' AS t FROM benchmark)
SELECT item_id, doc_id FROM b JOIN d ON contains(d.t, b.t)""")
def decontam_contains(spark, d):
    return J.phrases(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark").withColumnRenamed("text", "item_text"), "item_id", "item_text")


@query("recon_full_outer", """
WITH a AS (SELECT o_custkey AS k, count(*) AS l FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, count(*) AS r FROM customer GROUP BY 1)
SELECT k AS custkey, coalesce(l, 0) AS left_rows, coalesce(r, 0) AS right_rows, CASE WHEN l IS NULL THEN 'missing' WHEN r IS NULL THEN 'extra' WHEN l > 1 THEN 'duplicate' ELSE 'matched' END AS state FROM a FULL JOIN b USING (k)""")
def recon_full_outer(spark, d):
    return J.reconciled(table(spark, d, "orders").select(F.col("o_custkey").alias("custkey")), table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")), "custkey")


@query("routed_merge", """
WITH o AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, o_orderpriority AS priority, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND v IS NOT NULL THEN v ELSE o_totalprice END AS response, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND v IS NOT NULL THEN 'candidate' ELSE 'base' END AS source
FROM orders LEFT JOIN o ON o_orderkey = k""")
def routed_merge(spark, d):
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("response"))
    other = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("response"))
    return J.routed(base, other, "id", F.col("priority").isin("1-URGENT", "2-HIGH"), "response", ("base", "candidate"))


_LATEST = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts {0}, event_id {0}) = 1"


@query("last_wins", _LATEST.format("DESC"))
def last_wins(spark, d):
    return J.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).drop("ts")


@query("first_wins", _LATEST.format("ASC"))
def first_wins(spark, d):
    return J.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], F.asc("ts"), F.asc("event_id")).drop("ts")


@query("source_precedence", """
WITH u AS (SELECT doc_id AS id, 0 AS prio, 'labels' AS origin FROM labels UNION ALL SELECT doc_id, 1, 'documents' FROM documents)
SELECT id, origin FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY prio) = 1""")
def source_precedence(spark, d):
    ranked = [table(spark, d, t).select(F.col("doc_id").alias("id"), F.lit(i).alias("prio"), F.lit(t).alias("origin")) for i, t in enumerate(("labels", "documents"))]
    return J.latest(ranked[0].unionByName(ranked[1]), ["id"], F.asc("prio")).drop("prio")


@query("tri_state_recon", """
WITH t AS (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents),
s AS (SELECT CASE WHEN l.doc_id IS NULL THEN CASE WHEN n > 1 THEN 'failed' ELSE 'missing' END WHEN n > 1 THEN 'conflicting' WHEN quality = 1 THEN 'success' ELSE 'invalid' END AS state FROM t LEFT JOIN labels l USING (doc_id))
SELECT state, count(*) AS n FROM s GROUP BY state""")
def tri_state_recon(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    copies = J.repeated(docs.select(F.xxhash64("text").alias("h"), F.sha2(F.col("text").cast("binary"), 256).alias("s")), "h", "s").select("h", "s", F.lit(True).alias("failed"))
    marked = docs.select("doc_id", F.xxhash64("text").alias("h"), F.sha2(F.col("text").cast("binary"), 256).alias("s")).join(copies, ["h", "s"], "left")
    out = marked.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    state = F.when(F.col("quality").isNull(), F.when(F.col("failed"), "failed").otherwise("missing")).when(F.col("failed"), "conflicting").when(F.col("quality") == 1, "success").otherwise("invalid")
    return out.select(state.alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query("asof_train_before_eval", """
SELECT e.user_id, e.event_id, e.ts, c.event_id AS click_id, c.ts AS ts_found FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def asof_train_before_eval(spark, d):
    e = table(spark, d, "events")
    clicks = e.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return J.as_of(clicks, e.filter("event_type = 'error'").select("user_id", "ts", "event_id"), "user_id", "ts", "click_id")


@query("duplicate_ids", "SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("majority_vote", """
WITH v AS (SELECT user_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS choice, event_id FROM events),
c AS (SELECT user_id, choice, count(*) AS votes, min(event_id) AS first_position FROM v GROUP BY 1, 2),
t AS (SELECT user_id, sum(votes)::BIGINT AS samples, min(first_position) AS f FROM c GROUP BY 1),
b AS (SELECT * FROM c WHERE choice <> '' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first_position) = 1)
SELECT user_id, coalesce(choice, '') AS choice, coalesce(votes, 0) AS votes, coalesce(first_position, f) AS first_position, samples FROM t LEFT JOIN b USING (user_id)""")
def majority_vote(spark, d):
    votes = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("choice"), "event_id")
    return S.majority(votes, "user_id", "choice", "event_id")


@query("vote_conversation", """
WITH v AS (SELECT conv_id, split_part(text, ' ', 1) AS choice, turn FROM conversations),
c AS (SELECT conv_id, choice, count(*) AS votes, min(turn) AS first_position FROM v GROUP BY 1, 2),
t AS (SELECT conv_id, sum(votes)::BIGINT AS samples, min(first_position) AS f FROM c GROUP BY 1),
b AS (SELECT * FROM c WHERE choice <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY votes DESC, first_position) = 1)
SELECT conv_id, coalesce(choice, '') AS choice, coalesce(votes, 0) AS votes, coalesce(first_position, f) AS first_position, samples FROM t LEFT JOIN b USING (conv_id)""")
def vote_conversation(spark, d):
    votes = table(spark, d, "conversations").select("conv_id", F.substring_index("text", " ", 1).alias("choice"), "turn")
    return S.majority(votes, "conv_id", "choice", "turn")


@query("best_by_metric", "SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) = 1")
def best_by_metric(spark, d):
    # A minimum of structs: rows of a part are combined before they move, and nothing is sorted.
    best = F.min(F.struct("l_extendedprice", "l_orderkey", "l_linenumber"))
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(best.alias("b")).select("l_partkey", "b.l_orderkey", "b.l_linenumber", "b.l_extendedprice")


@query("role_sequence_valid", """
WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, count(*) AS turns, bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'user' THEN role = 'assistant' ELSE role = 'user' END) AS valid FROM t GROUP BY conv_id""")
def role_sequence_valid(spark, d):
    from pyspark.sql import Window

    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    ok = F.when(F.col("before").isNull(), F.col("role").isin("system", "user")).when(F.col("before") == "user", F.col("role") == "assistant").otherwise(F.col("role") == "user")
    return table(spark, d, "conversations").withColumn("before", before).groupBy("conv_id").agg(F.count("*").alias("turns"), F.bool_and(ok).alias("valid"))
