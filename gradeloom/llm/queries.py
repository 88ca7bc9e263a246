"""The contract queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, brown_lm, conversation_repair, filter_audit, fingerprints, html_extract, jaccard, langid, mixing, quality_gam, sharding, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_html_extract": html_extract.op1,
    "op2_fingerprints": fingerprints.op2,
    "op3_topk": topk.op3,
    "op4_jaccard_join": jaccard.op4,
    "op5_toxicity": toxicity.op5,
    "op6_brown_lm": brown_lm.op6,
    "op7_language_id": langid.op7,
    "op8_sharding": sharding.op8,
    "op9_bpe": bpe.op9,
    "op10_mixing": mixing.op10,
    "op11_quality_gam": quality_gam.op11,
    "op12_conversation_repair": conversation_repair.op12,
    "op13_filter_audit": filter_audit.op13,
}

ORACLES: dict[str, str] = {
    "op3_topk": topk.OP3_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
