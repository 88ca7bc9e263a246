"""Mixing sources to target weights, by blocks.

A source's words are one line, its documents in order of doc_id, cut into blocks of one length: ``block`` words, or fewer in a source of fewer than
``least`` such blocks, so that small sources meet their targets too (the last block may be shorter). A source's target gives its number of block
slots; how many of them each output shard takes is a multinomial draw. Slot j of a source with n blocks takes block perm(j mod n), where perm is
a keyed pseudorandom permutation (a Feistel network) of that source and round j div n; a shard takes the next so many slots. Slots and the
documents' pieces of blocks are then joined by source and block.

So each block of a source is taken equally often, give or take one, a target of at most ``most`` times the source takes no block more often
than that, and taken words differ from the target by about a block. Everything follows from ids, sizes and a seed: reruns agree.
Sizes and ids move; texts move once, to their pieces, where the mix is asked for as documents. Sources are rows of a table: the driver holds a number a
partition, and the level to which targets are filled. A hot source is spread by its block numbers; the table of sources is broadcast if it is small by
count, otherwise joined, where adaptive execution splits a hot source.

Defined cases: a null text has size 0 and takes part with no words; sources order by code point, null last; a source without words has target 0;
repeated rows are documents of their own, each with its own place; an empty table gives no rows; extra columns are carried by ``mixed``, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sharding import running
from .shared import _WORD, INT, LONG, batch_of, checkpointed, durable, few_rows_a_batch, schema, small_batches, texts

WEIGHTS, SHARE, MOST, BLOCK, LEAST, SHARDS, SEED = (5, 2, 1), 1.5, 2.0, 128, 256, 8, 20_240_601

#: Bytes of text whose words are counted at a time; counting takes about twenty times as many.
SLICE = 1 << 20
#: Sources that may be broadcast, and slots that one row of the plan stands for.
FEW_SOURCES, CHUNK = 50_000, 200_000


def filled(sources: DataFrame, share: float = SHARE, most: float = MOST) -> float:
    """The level L at which targets least(L * weight, most * size) add up to ``share`` of all words.

    sources: source_size and weight. Starting from equal shares, sources that are full stop and the rest share the excess by weight, until none is above.
    Each round is one aggregate of the table; the level only rises.
    """
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(most)
        total, kept, open_, count = sources.agg(F.sum("source_size"), F.sum(F.when(above, F.col("source_size") * F.lit(most)).otherwise(0.0)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if not total or not open_ or count == full:
            return level
        level, full = (share * total - kept) / open_, count


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of 0..n-1 puts each index: four Feistel rounds, walked on until the value is below n."""
    half = np.uint64(max(1, ((max(2, n) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        with np.errstate(over="ignore"):
            for r in range(4):
                f = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << half) | right

    x = once(index.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text of an Arrow column, counted over its whole byte buffer at once; 0 for null."""
    text = column.cast(pa.large_binary()) if len(column) else pa.array([], pa.large_binary())
    if not len(text):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    inside = ~space[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = offsets - offsets[0]
    firsts = at[:-1][at[:-1] < at[1:]]
    begin[firsts] = inside[firsts]
    sums = np.concatenate([[0], np.cumsum(begin)])
    out = sums[at[1:]] - sums[at[:-1]]
    return np.where(np.asarray(column.is_null()), 0, out)


def sized(docs: DataFrame) -> DataFrame:
    """__row, doc_id, source and size of each document (__row, doc_id, source, text)."""
    chosen = docs.select("__row", "doc_id", "source", "text")
    kinds = T.StructType([*chosen.schema.fields[:-1], *schema(size=LONG).fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, SLICE):
            yield batch_of(kinds, {c: b.column(c) for c in ("__row", "doc_id", "source")} | {"size": pa.array(word_counts(b.column("text")))})

    return chosen.mapInArrow(rows, kinds)


def key_of(source: str | None, seed: int) -> int:
    return zlib.crc32(f"{seed}:{source is None}:{source or ''}".encode())


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, least: int = LEAST, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Pieces and slots of documents (__row, doc_id, source, text).

    pieces: __row, doc_id, size, source_size, target, __source (number), __block, first and words (of the document, in the block), one row for each
    document and block that meet; a document without words has one with block -1. slots: __source, __block, out_shard, slot.
    """
    few_rows_a_batch(docs.sparkSession)
    keys = (F.col("source").asc_nulls_last(), "doc_id", "size", "__row")
    line, _ = running(checkpointed(sized(docs).repartitionByRange(*keys).sortWithinPartitions(*keys)), "size")
    by_source = line.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("__start").alias("__first"))
    order = F.col("source").asc_nulls_last()
    numbered, _ = running(checkpointed(by_source.repartitionByRange(order).sortWithinPartitions(order)), "source_size")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__index") % len(weights) + 1).cast(INT))
    sources = numbered.select("source", "source_size", "__first", F.col("__index").alias("__source"), weight.alias("weight"))
    level = filled(sources, share, most)
    size = F.least(F.lit(block).cast(LONG), F.greatest(F.lit(1).cast(LONG), F.floor(F.col("source_size") / least)))
    sources = sources.withColumns({"target": F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(most)), "__size": size}).withColumn("__blocks", F.ceil(F.col("source_size") / F.col("__size")))
    wanted = F.least(F.floor(F.col("__blocks") * F.lit(most)), F.round(F.col("target") * F.col("__blocks") / F.col("source_size")).cast(LONG))
    sources = durable(sources.withColumn("__slots", F.when(F.col("source_size") > 0, wanted).otherwise(0)))

    some = sources.select(F.col("source").alias("__s"), "source_size", "target", "__first", "__source", "__size")
    some = F.broadcast(some) if sources.count() <= FEW_SOURCES else some
    placed = line.join(some, F.col("source").eqNullSafe(F.col("__s"))).withColumn("__at", F.col("__start") - F.col("__first"))
    ends = F.col("__at") + F.col("size")
    numbers = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("__at") / F.col("__size")), F.floor((ends - 1) / F.col("__size")))).otherwise(F.array(F.lit(-1).cast(LONG)))
    begin, end = F.greatest("__at", F.col("__block") * F.col("__size")), F.least(ends, (F.col("__block") + 1) * F.col("__size"))
    pieces = placed.withColumn("__block", F.explode(numbers)).withColumns({"first": F.when(F.col("__block") >= 0, begin - F.col("__at")).otherwise(0), "words": F.when(F.col("__block") >= 0, end - begin).otherwise(0)})
    pieces = pieces.select("__row", "doc_id", "size", "source_size", "target", "__source", "__block", "first", "words")

    # How many of a source's slots each output shard takes: one multinomial draw a source, as running ends.
    dealt_kinds = T.StructType([*schema(__source=LONG, __blocks=LONG, __key=LONG, __slots=LONG).fields, T.StructField("__cuts", T.ArrayType(LONG))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys_ = [key_of(s, seed) for s in b.column("source").to_pylist()]
            cuts = [np.cumsum(np.random.default_rng([seed, k]).multinomial(n, [1 / shards] * shards)).tolist() for k, n in zip(keys_, b.column("__slots").to_pylist(), strict=True)]
            yield batch_of(dealt_kinds, {c: b.column(c) for c in ("__source", "__blocks", "__slots")} | {"__key": keys_, "__cuts": cuts})

    dealt = sources.select("source", "__source", "__blocks", "__slots").mapInArrow(deal, dealt_kinds)
    runs = dealt.filter("__slots > 0").withColumn("__from", F.explode(F.sequence(F.lit(0).cast(LONG), F.col("__slots") - 1, F.lit(CHUNK).cast(LONG)))).repartition("__source", "__from")
    slot_kinds = schema(__source=LONG, __block=LONG, out_shard=INT, slot=LONG)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, n, key, slots, cuts, start in zip(*(b.column(c).to_pylist() for c in ("__source", "__blocks", "__key", "__slots", "__cuts", "__from")), strict=True):
                j = np.arange(start, min(start + CHUNK, slots))
                taken_ = np.zeros(len(j), np.int64)
                for e in np.unique(j // n):
                    now = j // n == e
                    taken_[now] = permuted(j[now] % n, n, key + 7919 * int(e))
                shard = np.searchsorted(np.array(cuts), j, "right").astype(np.int32)
                yield batch_of(slot_kinds, {"__source": pa.array(np.full(len(j), source)), "__block": pa.array(taken_), "out_shard": pa.array(shard), "slot": pa.array(j)})

    return pieces, runs.mapInArrow(draw, slot_kinds)


def taken(docs: DataFrame, shards: int = SHARDS, **parameters) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document, and shard_words: the words of it that each output shard takes."""
    pieces, slots = mix(docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "source", "text"), shards=shards, **parameters)
    joined = pieces.join(slots.hint("merge"), ["__source", "__block"], "left")
    share = [F.coalesce(F.sum(F.when(F.col("out_shard") == k, F.col("words"))), F.lit(0)).cast(LONG) for k in range(shards)]
    whole = joined.groupBy("__row", "doc_id", "size", "source_size", "target").agg(F.array(*share).alias("shard_words"))
    return whole.select("doc_id", "size", "source_size", "target", F.aggregate("shard_words", F.lit(0).cast(LONG), lambda a, x: a + x).alias("taken"), "shard_words")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The mix as documents: all columns of ``docs``, text and n_chars replaced by the words that an output shard takes of a document.

    A row for each document and output shard that takes words of it, two if the shard takes a block twice. Neighbouring blocks keep their text as
    it was; runs that don't touch are joined by a line break. Documents of which nothing is taken have no row. The documents are written once with
    their row's number, so that their pieces find them whatever is computed again.
    """
    names = docs.columns
    kinds = docs.schema
    own = {c: f"c{i}" for i, c in enumerate(names)}
    keyed = durable(docs.select(*(F.col(f"`{c}`").alias(own[c]) for c in names), F.monotonically_increasing_id().alias("__row")))
    pieces, slots = mix(keyed.select("__row", *(F.col(own[c]).alias(c) for c in ("doc_id", "source", "text"))), **parameters)
    runs = pieces.join(slots.hint("merge"), ["__source", "__block"]).groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("out_shard", "first", "words"))).alias("__runs"))  # a row a block of one document

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 8 << 20):
            which, out = [], []
            for i, (text, runs_) in enumerate(zip(texts(b.column(own["text"])), b.column("__runs").to_pylist(), strict=True)):
                spans = [m.span() for m in _WORD.finditer(text)]
                new = [selected(text, spans, piece) for piece in shares([(r["out_shard"], r["first"], r["words"]) for r in runs_])]
                which += [i] * len(new)
                out += new
            at = pa.array(which, pa.int64())
            made = {c: b.column(own[c]).take(at) for c in names} | {"text": out}
            if "n_chars" in made:
                made["n_chars"] = pa.array([len(t) for t in out], pa.int64())
            yield batch_of(kinds, made)

    return keyed.join(runs, "__row").drop("__row").mapInArrow(rows, kinds)


def shares(runs: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """Runs of words (from, to) of each row that a document gives: one a shard, a second if the shard has a block twice. runs: shard, first word, words."""
    rows: dict[tuple[int, int], list[tuple[int, int]]] = {}
    seen: dict[tuple[int, int], int] = {}
    for shard, first, words in sorted(runs):
        nth = seen.get((shard, first), 0)
        seen[shard, first] = nth + 1
        rows.setdefault((shard, nth), []).append((first, first + words))
    return [rows[k] for k in sorted(rows)]


def selected(text: str, spans: list[tuple[int, int]], runs: list[tuple[int, int]]) -> str:
    """The words from .. to of a text, with what stands between them; runs that don't touch are joined by a line break."""
    merged: list[list[int]] = []
    for a, z in sorted(runs):
        if merged and merged[-1][1] == a:
            merged[-1][1] = z
        else:
            merged.append([a, z])
    return "\n".join(text[spans[a][0] : spans[z - 1][1]] for a, z in merged)


def op10(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
