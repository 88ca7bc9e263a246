"""Contiguous shards of near equal byte size, by global prefix sums.

Rows are put in one global order (hash of the text, then doc_id), each partition's byte total goes to the driver, the totals'
running sum gives each partition its start, and a second pass gives each row its start. The line of bytes is cut at equal targets.
Only ids, sizes and hashes move; texts are read once and stay where they are.

Equal texts stand together in that order. A cut that falls within such a group moves to the group's nearer end if the group is
smaller than ``group_share`` of a shard's target; a larger group, such as one with a third of all rows, is cut where the target falls,
so sizes stay near equal. Range partitioning is by hash, id and row, so a large group is spread over as many partitions as it fills.

Defined cases: a null text has no bytes and size 1; empty tables give no rows; null ids come first within their text;
repeated rows each get a slot of their own. A row belongs to the shard in which its middle byte lies, so a row longer than a target
leaves a neighbouring shard empty rather than being split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import INT, LONG, batch_of, checkpointed, schema


def running(ordered: DataFrame, size: str) -> tuple[DataFrame, int]:
    """``ordered`` (rows in fixed partitions) with __start (bytes before the row) and __index (rows before it), and the sum of all sizes."""
    totals = ordered.select(F.spark_partition_id().alias("p"), F.col(size).alias("s")).groupBy("p").agg(F.sum("s"), F.count("*")).collect()
    totals.sort()
    starts, at, index = {}, 0, 0
    for p, s, n in totals:
        starts[p] = (at, index)
        at, index = at + s, index + n
    names = ordered.columns
    kinds = T.StructType([*ordered.schema.fields, *schema(__start=LONG, __index=LONG).fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = starts.get(TaskContext.get().partitionId(), (0, 0))
        for b in batches:
            s = b.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = at + np.cumsum(s)
            yield batch_of(kinds, {c: b.column(c) for c in names} | {"__start": pa.array(ends - s), "__index": pa.array(index + np.arange(len(s)))})
            at, index = at + int(s.sum()), index + len(s)

    return ordered.mapInArrow(rows, kinds), at


def shards(docs: DataFrame, count: int = 8, group_share: float = 0.02) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of documents (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast(LONG) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__h"), F.monotonically_increasing_id().alias("__row"))
    keys = ("__h", "doc_id", "__row")
    ordered = checkpointed(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__row"))
    placed, total = running(ordered, "size")
    targets = np.array([total * k / count for k in range(1, count)])

    # The groups that hold a target, at most one a cut, and where they start and end.
    held = schema(__h=LONG)

    def at_targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, size = (b.column(c).to_numpy(zero_copy_only=False) for c in ("__start", "size"))
            has = np.searchsorted(targets, start, "left") < np.searchsorted(targets, start + size, "left")
            yield batch_of(held, {"__h": b.column("__h").filter(pa.array(has))})

    groups = sorted({r[0] for r in placed.mapInArrow(at_targets, held).collect()})
    extents = placed.filter(F.col("__h").isin(groups)).groupBy("__h").agg(F.min("__start"), F.max(F.col("__start") + F.col("size"))).collect() if groups else []
    cuts = targets.copy()
    for _, a, z in extents:
        inside = (cuts > a) & (cuts < z)
        if z - a <= group_share * total / count:
            cuts[inside] = np.where(cuts[inside] - a <= z - cuts[inside], a, z)

    kinds = schema(doc_id=docs.schema["doc_id"].dataType, size=LONG, text_crc32=LONG, shard=INT, __index=LONG)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            middle = b.column("__start").to_numpy() + b.column("size").to_numpy(zero_copy_only=False) / 2
            yield batch_of(kinds, {c: b.column(c) for c in ("doc_id", "size", "text_crc32", "__index")} | {"shard": pa.array(np.searchsorted(cuts, middle, "right").astype(np.int32))})

    dealt = placed.mapInArrow(deal, kinds)
    first = {r[0]: r[1] for r in dealt.groupBy("shard").agg(F.min("__index")).collect()}
    before = F.element_at(F.create_map(*(F.lit(x) for k, v in sorted(first.items()) for x in (k, v))), F.col("shard")) if first else F.lit(0)
    return dealt.select("doc_id", "size", "text_crc32", "shard", (F.col("__index") - before).cast(LONG).alias("slot"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shards(docs).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast(INT)})
