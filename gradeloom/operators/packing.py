"""Prompts into batches by their padded size, in order, and what a batch's responses may take of the context.

A batch of n prompts takes n times its longest one. Rows are cut into chunks by the running sum of their tokens (``splitting.running``), which no task has to hold,
and each chunk, of ``limit`` tokens and one row at most, is packed in its order: a row that would take its batch over the limit begins the next one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .splitting import running


def next_fit(tokens: list[int], limit: int) -> list[int]:
    """The batch of each row, from 0; a row over the limit has one of its own."""
    out, batch, n, longest = [], 0, 0, 0
    for t in tokens:
        if n and (n + 1) * max(longest, t) > limit:
            batch, n, longest = batch + 1, 0, 0
        n, longest = n + 1, max(longest, t)
        out.append(batch)
    return out


def packed(rows: DataFrame, order: list[str], tokens: Column, limit: int) -> DataFrame:
    """The columns ``order`` (together without ties) of rows with tokens (1 at least), chunk and batch within it. Null tokens count 1."""
    sized = rows.select(*order, F.greatest(F.lit(1), F.coalesce(tokens, F.lit(1))).cast("long").alias("tokens"))
    chunked = running(sized, [], order, F.col("tokens"), "__before").select(*order, "tokens", F.floor(F.col("__before") / limit).cast("long").alias("chunk"))
    kinds = T.StructType([*chunked.schema.fields, T.StructField("batch", T.LongType())])

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, na_position="first")
        return part.assign(batch=next_fit(part["tokens"].tolist(), limit))

    return chunked.groupBy("chunk").applyInPandas(pack, kinds)


def budgets(batches: DataFrame, by: list[str], cap: int, context: int, margin: int) -> DataFrame:
    """by, prompts, longest, padded, and the tokens that a response may take: what the context leaves beside the longest prompt and a margin, up to ``cap``; 0 if nothing."""
    longest = F.max("tokens")
    room = F.least(F.lit(cap).cast("long"), context - longest - margin)
    return batches.groupBy(*by).agg(F.count("*").alias("prompts"), longest.alias("longest"), (F.count("*") * longest).alias("padded"), F.greatest(F.lit(0).cast("long"), room).alias("budget"))


