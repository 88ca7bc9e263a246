"""Loops over what is left: staged fallback with budgets, and logs of batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches, staging
from . import recipes as R
from .registry import query, table

#: How many tokens an order's answer takes, how long a bounded answer is, and which orders a repair helps.
_NEEDS, _FREE = "CAST(floor(o_totalprice / 60) AS INT)", "o_custkey % 4 > 0"
_STEPS = [("repair", 0), ("continuation", 400), ("continuation", 800), ("continuation", 1600), ("continuation", 3200), ("bounded", 500), ("high_budget", 6000)]
_ANSWERS = {
    "repair": "o_orderpriority = '1-URGENT' AND o_totalprice < 200000", "continuation": f"{_NEEDS} <= {{budget}}", "bounded": "o_orderstatus = 'P'", "high_budget": f"{_NEEDS} <= {{budget}}",
}
#: An attempt's text ends in a box if it has an answer, and without one if not; what is cut off has a long line of reasoning in its box.
_SAID = f"CASE WHEN {{ok}} THEN 'so ' || {R.box("o_orderkey || ' by {stage}'")} WHEN o_custkey % 2 = 0 THEN {R.box("'wait, we need ' || o_orderkey")} ELSE 'on and on' END"


def _effect(name: str) -> staging.Effect:
    def effect(asked, budget):
        ok = _ANSWERS[name].format(budget=budget)
        finish = f"CASE WHEN {ok} THEN 'stop' ELSE 'length' END"
        # One order in eleven gets no response at all.
        return asked.filter("o_orderkey % 11 <> 3").select("o_orderkey", F.expr(_SAID.replace("{ok}", ok).replace("{stage}", name)).alias("response"), F.expr(finish).alias("finish_reason"))

    return effect


def _stages() -> list[staging.Stage]:
    return [
        staging.Stage("repair", _effect("repair")), staging.Stage("continuation", _effect("continuation"), 400, 3200, F.expr(_FREE)),
        staging.Stage("bounded", _effect("bounded"), 500), staging.Stage("high_budget", _effect("high_budget"), 6000),
    ]


_LOOP_SQL = f"""
WITH RECURSIVE p AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}', {b})" for i, (n, b) in enumerate(_STEPS, 1))}) AS t(step, stage, budget)),
o AS (SELECT *, {_NEEDS} AS needs FROM orders),
-- One row an order and step: whether the stage takes it, its text and whether that is an answer.
s AS (SELECT o_orderkey, 0 AS step, 'length' AS finish, FALSE AS done, FALSE AS asked, FALSE AS answered, FALSE AS short, '' AS response, 0 AS attempts FROM o
    UNION ALL
    SELECT o_orderkey, step, CASE WHEN answered THEN CASE WHEN ok THEN 'stop' ELSE 'length' END ELSE finish END, done OR (answered AND good), asked, answered, answered AND NOT good AND NOT ok, CASE WHEN answered THEN text ELSE '' END, attempts + answered::INT
    FROM (SELECT *, asked AND o_orderkey % 11 <> 3 AS answered, regexp_matches(text, '\\\\boxed\\{{[^{{}}]+\\}}') AND NOT (NOT ok AND regexp_matches(text, 'wait|we need')) AS good
        FROM (SELECT *, CASE WHEN ok THEN 'so ' || chr(92) || 'boxed{{' || o_orderkey || ' by ' || stage || '}}' WHEN o_custkey % 2 = 0 THEN chr(92) || 'boxed{{wait, we need ' || o_orderkey || '}}' ELSE 'on and on' END AS text
            FROM (SELECT o.o_orderkey, o.o_custkey, s.finish, s.done, s.attempts, p.step, p.stage, NOT s.done AND (p.stage <> 'continuation' OR (o.o_custkey % 4 > 0 AND s.finish = 'length')) AS asked,
                CASE p.stage WHEN 'repair' THEN o_orderpriority = '1-URGENT' AND o_totalprice < 200000 WHEN 'bounded' THEN o_orderstatus = 'P' ELSE needs <= p.budget END AS ok
                FROM s JOIN o ON o.o_orderkey = s.o_orderkey JOIN p ON p.step = s.step + 1))))
"""


def _outcome(spark, d) -> staging.Outcome:
    orders = table(spark, d, "orders").withColumns({"response": F.lit("cut"), "finish_reason": F.lit("length")})
    group = F.regexp_extract("response", r"\\boxed\{([^{}]+)\}", 1)
    accept = (group != "") & ~((F.col("finish_reason") == "length") & group.rlike("wait|we need"))
    return staging.run(orders, _stages(), accept, "o_orderkey")


@query("stage_loop", _LOOP_SQL + """
SELECT o_orderkey, coalesce(max(s.response) FILTER (s.done AND s.answered), 'cut') AS response, coalesce(max(p.stage) FILTER (s.done AND s.answered), 'none') AS stage, coalesce(max(p.budget) FILTER (s.done AND s.answered), -1) AS budget, max(s.attempts)::BIGINT AS attempts
FROM s LEFT JOIN p ON p.step = s.step GROUP BY o_orderkey""")
def stage_loop(spark, d):
    """Each order's accepted response, the stage and budget that gave it, and how often it was asked."""
    return _outcome(spark, d).rows.select("o_orderkey", "response", "stage", F.coalesce("budget", F.lit(-1)).alias("budget"), "attempts")


@query("stage_counts", _LOOP_SQL + """
SELECT p.step, p.stage, p.budget, count(*) FILTER (asked) AS asked, count(*) FILTER (answered) AS answered, count(*) FILTER (answered AND done) AS accepted, count(*) FILTER (short) AS cut_off, count(*) FILTER (NOT done) AS left_over
FROM s JOIN p ON p.step = s.step GROUP BY ALL""")
def stage_counts(spark, d):
    """How many orders each step of the loop is asked for, answers, settles and leaves."""
    return _outcome(spark, d).counts.withColumnRenamed("left", "left_over")


#: Reports of batches: an event's kind and number give a status; users are batches, orders give each a last report.
_REPORT = "CASE event_type WHEN 'signup' THEN 'submitted' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'validating' ELSE 'in_progress' END WHEN 'click' THEN CASE WHEN event_id % 7 = 0 THEN 'finalizing' ELSE 'in_progress' END WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 5 = 1 THEN 'expired' ELSE 'unheard of' END ELSE CASE WHEN value > 60 THEN 'COMPLETED' ELSE 'cancelling' END END"
_ENDS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'submitted' ELSE 'cancelled' END"
_LOG = f"SELECT user_id * 100 + day(ts) AS batch, CAST(ts AS TIMESTAMP) AS moment, event_id AS n, {_REPORT} AS report FROM {{events}} UNION ALL SELECT o_custkey * 100 + 1 AS batch, CAST(o_orderdate AS TIMESTAMP) AS moment, o_orderkey AS n, {_ENDS} AS report FROM {{orders}}"


@query("batch_states", f"""
WITH l AS ({_LOG.format(events='events', orders='orders')}),
r AS (SELECT batch, list(lower(report) ORDER BY moment, n, lower(report)) AS reports FROM l GROUP BY batch),
f AS (SELECT batch, len(reports) AS reports, list_reduce(list_prepend('prepared|0', reports), lambda s, e: CASE WHEN list_contains(['completed', 'failed', 'expired', 'cancelled'], split_part(s, '|', 1)) THEN s
    WHEN list_contains(['completed', 'failed', 'expired', 'cancelled'], e) THEN CASE WHEN split_part(s, '|', 1) = 'prepared' THEN s ELSE e || '|' || (split_part(s, '|', 2)::INT + 1) END
    WHEN list_position(['prepared', 'submitted', 'validating', 'in_progress', 'finalizing', 'cancelling'], e) > list_position(['prepared', 'submitted', 'validating', 'in_progress', 'finalizing', 'cancelling'], split_part(s, '|', 1)) THEN e || '|' || (split_part(s, '|', 2)::INT + 1) ELSE s END) AS s FROM r)
SELECT batch, split_part(s, '|', 1) AS state, reports::BIGINT AS reports, split_part(s, '|', 2)::BIGINT AS changes FROM f""")
def batch_states(spark, d):
    """The state of each batch by all reports of it, late, repeated and unknown ones among them."""
    log = spark.sql(_LOG.format(events="{events}", orders="{orders}"), events=table(spark, d, "events"), orders=table(spark, d, "orders"))
    return batches.folded(log, ["batch"], ["moment", "n"])
