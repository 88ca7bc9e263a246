"""Batches of prompts and training rows as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat as C
from ..functions.text import token_estimate
from ..operators import packing
from .registry import query, table

_LIMIT, _CAP, _CONTEXT, _MARGIN = 8_192, 4_096, 6_000, 64
_PACKED = f"""
WITH RECURSIVE t AS (SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents),
c AS (SELECT doc_id, tokens, (coalesce(sum(tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {_LIMIT})::BIGINT AS chunk FROM t),
i AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id) AS i FROM c),
b AS (SELECT chunk, i, doc_id, tokens, 0::BIGINT AS batch, 1::BIGINT AS n, tokens AS longest FROM i WHERE i = 1
    UNION ALL SELECT i.chunk, i.i, i.doc_id, i.tokens, CASE WHEN over THEN batch + 1 ELSE batch END, CASE WHEN over THEN 1 ELSE n + 1 END, CASE WHEN over THEN i.tokens ELSE greatest(longest, i.tokens) END
    FROM (SELECT b.*, (b.n + 1) * greatest(b.longest, x.tokens) > {_LIMIT} AS over FROM b JOIN i x ON x.chunk = b.chunk AND x.i = b.i + 1) p JOIN i ON i.chunk = p.chunk AND i.i = p.i + 1)
"""


def _packed(spark, d):
    return packing.packed(table(spark, d, "documents"), ["doc_id"], token_estimate(F.col("text")), _LIMIT)


@query("packed_prompts", _PACKED + "SELECT doc_id, tokens, chunk, batch FROM b")
def packed_prompts(spark, d):
    return _packed(spark, d)


@query("batch_budgets", _PACKED + f"SELECT chunk, batch, count(*) AS prompts, max(tokens) AS longest, count(*) * max(tokens) AS padded, greatest(0, least({_CAP}, {_CONTEXT} - max(tokens) - {_MARGIN}))::BIGINT AS budget FROM b GROUP BY ALL")
def batch_budgets(spark, d):
    return packing.budgets(_packed(spark, d), ["chunk", "batch"], _CAP, _CONTEXT, _MARGIN)


@query("label_mask", r"""
WITH t AS (SELECT doc_id, concat('<|im_start|>system', chr(10), 'Answer.<|im_end|>', chr(10), '<|im_start|>user', chr(10), left(text, 40), '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10)) AS head, text, CASE WHEN doc_id % 5 = 0 THEN 'user' ELSE 'assistant' END AS role FROM documents),
f AS (SELECT doc_id, role, CASE WHEN role = 'assistant' THEN head || text ELSE replace(head, '<|im_start|>assistant', '<|im_start|>user') || text END || '<|im_end|>' || chr(10) AS whole, octet_length(encode(head)) AS b FROM t)
-- Tokens are pieces of three bytes; one is learned if its first byte is of the answer.
SELECT doc_id, md5(whole) AS text_md5, CAST(ceil(octet_length(encode(whole)) / 3) AS BIGINT) AS tokens, CASE WHEN role = 'assistant' THEN CAST(ceil(octet_length(encode(whole)) / 3) - ceil(b / 3) AS BIGINT) ELSE 0 END AS learned,
  CASE WHEN role = 'assistant' THEN CAST(ceil(b / 3) AS BIGINT) ELSE -1 END AS first FROM f""")
def label_mask(spark, d):
    """Documents as chat rows in tokens of three bytes, which cut characters apart; every fifth has no answer."""
    m = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    role = F.when(F.col("doc_id") % 5 == 0, "user").otherwise("assistant")
    rows = table(spark, d, "documents").select("doc_id", F.array(m(F.lit("system"), F.lit("Answer.")), m(F.lit("user"), F.substring("text", 1, 40)), m(role, F.col("text"))).alias("messages"))
    whole = rows.select("doc_id", C.rendered(F.col("messages")).alias("whole"), C.answer_start(F.col("messages")).alias("start"))
    octets = F.octet_length("whole")
    count = F.ceil(octets / 3).cast("int")
    tokens = whole.withColumn("lengths", F.transform(F.sequence(F.lit(1), count), lambda i: F.when(i == count, octets - 3 * (count - 1)).otherwise(3)))
    ids = F.sequence(F.lit(0), count - 1)
    marked = tokens.select("doc_id", "whole", C.labels(ids, C.token_spans("whole", "lengths"), F.col("start")).alias("labels"))
    first = F.coalesce(F.array_min(F.filter("labels", lambda x: x != C.IGNORED)), F.lit(-1))
    return marked.select("doc_id", F.md5(F.col("whole").cast("binary")).alias("text_md5"), F.size("labels").cast("long").alias("tokens"), C.learned(F.col("labels")).cast("long").alias("learned"), first.cast("long").alias("first"))
