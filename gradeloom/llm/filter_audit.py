"""Audit of filters that are applied one after another: what each removes, in every order, from a packed bitmap index.

Five filters judge a text: A too few words, B too few different words, C too many capitals, D marks of markup, E a text that a smaller id has.
A to D and a 128-bit digest of the text come from one pass over the texts; only ids, parts, four bits and the digest move after that. E asks for
the smallest id of each digest, the labels for an id: both are joins on keys that may be hot (``matched`` in shared).

The index holds a bitset for each filter, label and part of a batch of rows, packed by numpy: bit i says whether row i fails the filter, or has the label,
or is of the part. What survives a set S of filters is the part's bitset AND NOT each filter's of S; with popcounts of the 32 sets, and of the same AND each
label, a partition is summed up in 96 numbers a part, and partitions are added up by part and set. All that is reported follows from these counts:
what a filter removes after the filters S is survivors(S) - survivors(S and it), for each of the 120 orders.

Defined cases: a null text is the empty text, a null lang the part "". A null id is smaller than none and none is smaller than it. Repeated rows count
each; rows of one id with one text don't fail E by each other. An id with several labels has each that any of its rows gives it; null labels don't count.
Empty tables give no rows. Texts are the same when their 128-bit digests are: of a million million texts any two share one with a chance near 1e-15.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import INT, LONG, STRING, batch_of, durable, few_rows_a_batch, matched, schema, small_batches

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: Fixed values of the filters: words at least, different words and capitals in percent, marks.
LEAST_WORDS, LEAST_DIFFERENT, MOST_CAPITALS, MARKS = 200, 50, 3, b"#$%&*|"


def failures(text: bytes) -> int:
    """Bits 0 to 3: whether the text, in UTF-8, fails A, B, C, D."""
    words = text.split()  # bytes split at ASCII white space
    raw = np.frombuffer(text, np.uint8)
    points = len(raw) - int(((raw & 0xC0) == 0x80).sum())
    capitals = int(((raw >= 65) & (raw <= 90)).sum())
    marked = len(text.translate(None, MARKS)) < len(text)
    return (len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DIFFERENT * len(words)) << 1 | (100 * capitals > MOST_CAPITALS * points) << 2 | marked << 3


JUDGED = schema(doc_id=LONG, part=STRING, fails=INT, digest=T.BinaryType())


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, the failures A to D and a digest of each document's text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = [t or b"" for t in b.column("text").to_pylist()]
            yield batch_of(JUDGED, {"doc_id": b.column("doc_id"), "part": b.column("part"), "fails": [failures(t) for t in texts], "digest": [hashlib.blake2b(t, digest_size=16).digest() for t in texts]})

    few_rows_a_batch(docs.sparkSession)
    return docs.select(F.col("doc_id").cast(LONG), F.coalesce("lang", F.lit("")).alias("part"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, JUDGED)


def popcounts(part: np.ndarray, fails: np.ndarray, labels: list[np.ndarray], parts: int) -> np.ndarray:
    """For each part, set of filters, and all rows or those with a label: how many rows fail no filter of the set."""
    passes = [~np.packbits(fails >> i & 1) for i in range(len(FILTERS))]
    having = [np.packbits(x) for x in labels]
    out = np.zeros((parts, SETS, 1 + len(labels)), np.int64)
    for p in range(parts):
        # survivors[S] is survivors[S without its last filter] AND NOT that filter: 31 ANDs for 32 sets.
        survivors = np.empty((SETS, len(passes[0])), np.uint8)
        survivors[0] = np.packbits(part == p)
        for s in range(1, SETS):
            last = s.bit_length() - 1
            np.bitwise_and(survivors[s ^ 1 << last], passes[last], out=survivors[s])
        for i, held in enumerate((None, *having)):
            out[p, :, i] = np.bitwise_count(survivors if held is None else survivors & held).sum(1, dtype=np.int64)
    return out


def index(rows: DataFrame, size: int = 1 << 18) -> DataFrame:
    """part, filters (a set, as bits), kept, good, toxic: how many rows (part, fails, quality, toxic) of each part fail no filter of the set; bitsets of ``size`` rows or so."""
    kinds = schema(part=STRING, filters=INT, kept=LONG, good=LONG, toxic=LONG)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def add(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            part = t.column("part").combine_chunks().dictionary_encode()
            labels = [t.column(c).to_numpy() == 1 for c in ("quality", "toxic")]
            names = part.dictionary.to_pylist()
            for name, counts in zip(names, popcounts(part.indices.to_numpy(), t.column("fails").to_numpy(), labels, len(names)), strict=True):
                total[name] = total.get(name, 0) + counts

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= size:
                add(held)
                held, n = [], 0
        if n:
            add(held)
        for name, counts in total.items():
            yield batch_of(kinds, {"part": [name] * SETS, "filters": list(range(SETS)), "kept": counts[:, 0], "good": counts[:, 1], "toxic": counts[:, 2]})

    sums = rows.select("part", "fails", "quality", "toxic").mapInArrow(counted, kinds)
    return sums.groupBy("part", "filters").agg(*(F.sum(c).alias(c) for c in ("kept", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, parts: int = 1_000) -> DataFrame:
    """The report of documents (doc_id, text, lang) and labels (doc_id, quality, toxic): a row for each part, order of the filters and step."""
    rows = durable(judged(docs))
    # Only texts that several rows have can fail E; their number is what the join moves.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeats = F.coalesce((F.col("doc_id") > F.col("first_id")).cast(INT), F.lit(0))
    whole = durable(matched(rows, first, "digest", parts).select("doc_id", "part", F.col("fails").bitwiseOR(F.shiftleft(repeats, 4)).alias("fails")))
    label = labels.groupBy(F.col("doc_id").cast(LONG).alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return report(index(matched(whole, label, "doc_id", parts)))


def report(sets: DataFrame) -> DataFrame:
    """What ``index`` counted, for each part, order and step: 600 rows a part from its 32 counts."""
    held = F.array_sort(F.collect_list(F.struct("filters", "kept", "good", "toxic")))  # 32 of a part
    parts = sets.groupBy("part").agg(held.alias("s"))
    orders = F.explode(F.lit(["".join(o) for o in permutations(FILTERS)]))
    steps = parts.select("part", "s", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    done = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    bit = sum(((letter == x).cast(INT) * (1 << i) for i, x in enumerate(FILTERS)), F.lit(0))
    before = sum((done.contains(x).cast(INT) * (1 << i) for i, x in enumerate(FILTERS)), F.lit(0))
    placed = steps.withColumns({"bit": bit, "before": before})
    at = lambda s: F.element_at("s", s + 1)
    was, now, none, last, but = at(F.col("before")), at(F.col("before") + F.col("bit")), at(F.lit(0)), at(F.lit(SETS - 1)), at(SETS - 1 - F.col("bit"))
    removed = was["kept"] - now["kept"]
    # A set S of filters stands before another filter in |S|! (4 - |S|)! of the 120 orders.
    weights = [1, 1, 2, 6, 24]
    ways = F.lit([weights[bin(s).count("1")] * weights[4 - bin(s).count("1")] if s != SETS - 1 else 0 for s in range(SETS)])
    over = lambda s: (at(s)["kept"] - at(s + F.col("bit"))["kept"]) * F.element_at(ways, s + 1)
    free = F.filter(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda s: s.bitwiseAND(F.col("bit")) == 0)
    shapley = F.aggregate(F.transform(free, over), F.lit(0).cast(LONG), lambda a, x: a + x)
    return placed.select(
        "part", "filter_order", "step", now["kept"].alias("kept"), removed.alias("removed"),
        (none["kept"] - at(F.col("bit"))["kept"] - removed).alias("redundant"), (but["kept"] - last["kept"]).alias("unique_fails"),
        (was["good"] - now["good"]).alias("good_lost"), (was["toxic"] - now["toxic"]).alias("toxic_lost"), shapley.alias("shapley"),
    )


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


OP13_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY x) AS first_id FROM t),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, (coalesce(l.quality, 0) = 1)::INT AS good, (coalesce(l.toxic, 0) = 1)::INT AS toxic, {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x), 'D': regexp_matches(x, '[#$%&*|]'), 'E': coalesce(w.doc_id > first_id, FALSE)} AS f
    FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, good, toxic, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END, CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || h.c AS filter_order FROM x a, x b, x d, x e, x h WHERE length(replace(replace(replace(replace(replace('ABCDE', a.c, ''), b.c, ''), d.c, ''), e.c, ''), h.c, '')) = 0),
s AS (SELECT filter_order, step, filter_order[step] AS c, CASE WHEN step = 1 THEN '-' ELSE filter_order[1:step - 1] END AS done FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
r AS (SELECT part, filter_order, step, c,
    coalesce(sum(n) FILTER (NOT regexp_matches(fails, '[' || c || done || ']')), 0) AS kept,
    coalesce(sum(n) FILTER (contains(fails, c) AND NOT regexp_matches(fails, '[' || done || ']')), 0) AS removed,
    coalesce(sum(n) FILTER (contains(fails, c) AND regexp_matches(fails, '[' || done || ']')), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = c), 0) AS unique_fails,
    coalesce(sum(n) FILTER (good = 1 AND contains(fails, c) AND NOT regexp_matches(fails, '[' || done || ']')), 0) AS good_lost,
    coalesce(sum(n) FILTER (toxic = 1 AND contains(fails, c) AND NOT regexp_matches(fails, '[' || done || ']')), 0) AS toxic_lost
    FROM g, s GROUP BY part, filter_order, step, c)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM r
"""
