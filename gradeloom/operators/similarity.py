"""TF-IDF similarity of texts by character n-grams inside words, from posting lists or by equi-joins on grams, and vectors' cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import postings
from .cutting import cut, spread
from .splitting import quantiles


def word_grams(text: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams of each word between single spaces, lower case; a padded word shorter than n counts once, whole."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column) -> Column:
        # A padded word no longer than n is one gram, and larger sizes add nothing more.
        def runs(n: int) -> Column:
            none = F.array(w) if n == sizes[0] else F.array().cast("array<string>")
            return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(none)

        return F.concat(*map(runs, sizes))

    return F.flatten(F.transform(padded, of))


def tfidf(texts: DataFrame, key: str, text: str, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """key, gram, w: (1 + ln count) * (ln((1 + n) / (1 + df)) + 1), each text's vector of length 1."""
    n = texts.count()
    # Grams are made of each distinct word of a text once, then weighed by the word's count.
    words = texts.select(key, F.explode(F.filter(F.split(F.lower(F.col(text)), r"(?U)\s+"), lambda w: w != "")).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    counts = cut(words.select(key, "n", F.explode(word_grams(F.col("word"), sizes)).alias("gram")).groupBy(key, "gram").agg(F.sum("n").alias("tf")))
    df = counts.groupBy("gram").agg(F.count("*").alias("df"))
    idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    raw = counts.join(df, "gram").select(key, "gram", ((1.0 + F.log("tf")) * idf).alias("raw"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "gram", (F.col("raw") / F.col("norm")).alias("w"))


def most_similar(queries: DataFrame, candidates: DataFrame, k: int, sizes: tuple[int, ...] = (3, 4, 5), digits: int = 6, most_grams: int = postings.MOST_GRAMS) -> DataFrame:
    """query_id, rank, candidate_id, similarity: the k nearest candidates of each query; the vocabulary is that of both (id, text).

    Similarities are rounded before they are ranked; ties go to the smaller candidate id; rows without an id are texts of the vocabulary only. Up to ``most_grams`` different grams the queries'
    posting lists go to the candidates (``postings``), else both sides are joined by gram.
    """
    both = queries.select("text").unionAll(candidates.select("text"))
    df = cut(postings.frequencies(both, sizes))
    if df.count() <= most_grams:
        asked, there = (t.filter("id IS NOT NULL") for t in (queries, candidates))
        score = postings.nearest(asked, there, k, sizes, digits, df, both.count()).groupBy("query_id", "candidate_id").agg(F.max("similarity").alias("similarity"))
    else:
        score = _joined(queries, candidates, sizes, digits)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "candidate_id")
    return score.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "candidate_id", "similarity")


def _joined(queries: DataFrame, candidates: DataFrame, sizes: tuple[int, ...], digits: int) -> DataFrame:
    """query_id, candidate_id, similarity of all pairs that share a gram."""
    both = queries.select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("doc"), "text").unionByName(candidates.select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("doc"), "text"))
    w = cut(tfidf(both, "doc", "text", sizes))
    side = lambda p, name: w.filter(F.col("doc").startswith(p)).select(F.substring("doc", 2, 20).cast("long").alias(name), "gram", F.col("w").alias(f"w_{name}"))
    return side("q", "query_id").join(side("c", "candidate_id"), "gram").groupBy("query_id", "candidate_id").agg(F.round(F.sum(F.col("w_query_id") * F.col("w_candidate_id")), digits).alias("similarity"))


def best_metrics(queries: DataFrame, nearest: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5)) -> DataFrame:
    """Mean, median and counts over thresholds of each query's best similarity; queries without any count as 0."""
    best = cut(queries.select(F.col("id").alias("query_id")).join(nearest.filter("rank = 1").select("query_id", "similarity"), "query_id", "left").select(F.coalesce("similarity", F.lit(0.0)).alias("s")))
    median = quantiles(best, [], "s", [0.5]).select(F.round(F.get("quantiles", F.lit(0)), 5).alias("median_best"))
    return best.agg(F.count("*").alias("queries"), F.round(F.avg("s"), 5).alias("mean_best"), *(F.count_if(F.col("s") >= t).alias(f"at_least_{int(100 * t)}") for t in thresholds)).join(F.broadcast(median))  # one row is broadcast


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Query vectors that go to the tasks at a time, and rows that are compared with them at once.
BLOCK, ROWS = 1_000, 2_000


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up from the first component on, as ``dot`` does."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def best_of(rows: tuple[np.ndarray, np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ids of rows and cosines (each: ids, vectors, norms) that hold each query's k best by rounded cosine, smaller ids first.

    Products of matrices, whose last bits depend on the order of sums, only say which pairs can be among them; those are computed in order. Of equal cosines, as copies have, the k smallest ids stay.
    """
    (ids, x, n), (own, q, qn) = rows, asked
    margin = 2.0 * 10.0**-digits  # twice what rounding and the order of sums can move
    with np.errstate(all="ignore"):
        rough = (q @ x.T) / (qn[:, None] * n[None, :])
    rough[np.isnan(rough)] = np.inf  # what isn't a number ranks first
    rough[own[:, None] == ids[None, :]] = -np.inf
    least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(own), -np.inf)
    at, row = np.nonzero((rough >= (least - margin)[:, None]) & (rough > -np.inf))
    cosine = np.concatenate([np.empty(0), *(_in_order(x[r], q[a]) / (n[r] * qn[a]) for a, r in ((at[z : z + ROWS], row[z : z + ROWS]) for z in range(0, len(at), ROWS)))])
    order = np.lexsort((ids[row], -cosine, at))
    at, row, cosine = at[order], row[order], cosine[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ((cosine[1:] != cosine[:-1]) & ~(np.isnan(cosine[1:]) & np.isnan(cosine[:-1])))
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    keep = np.arange(len(at)) - first < k
    return at[keep], ids[row[keep]], cosine[keep]


def cosine_top_k(vectors: DataFrame, is_query: Column, k: int, digits: int = 5, block: int = BLOCK) -> DataFrame:
    """The k nearest rows (vec_id, embedding) of each query by cosine, the query itself left out.

    Queries are counted first and dealt by a hash of their ids into broadcast blocks of about ``block``; beyond one, each block's result is cut before the next. Tasks multiply blocks of rows with
    the queries and give a few rows a query and block, which a window ranks. For exact search over many queries use an index; this compares each query with each row.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    unit = vectors.select("vec_id", x.alias("x"), F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("norm")).filter("norm > 0")
    asked = unit.filter(is_query)
    blocks = max(1, -(-asked.count() // block))
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "candidate_id")
    context = vectors.sparkSession.sparkContext
    there = spread(vectors).select("vec_id", x.alias("x"), F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("norm")).filter("norm > 0")
    there = cut(there) if blocks > 1 else there
    done = None
    for i in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toArrow()  # a block of queries
        shipped = context.broadcast(_matrix(mine.combine_chunks().to_batches()[0]) if mine.num_rows else None)

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            if shipped.value is None:
                return
            own = shipped.value
            for b in batches:
                for z in range(0, b.num_rows, ROWS):
                    at, ids, cosine = best_of(_matrix(b.slice(z, ROWS)), own, k, digits)
                    yield pa.RecordBatch.from_arrays([pa.array(own[0][at]), pa.array(ids), pa.array(cosine)], ["query_id", "candidate_id", "cosine"])

        scored = there.mapInArrow(search, "query_id long, candidate_id long, cosine double").withColumn("cosine", F.round("cosine", digits))
        found = scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "candidate_id", "cosine")
        found = cut(found) if blocks > 1 else found
        done = found if done is None else done.unionAll(found)
    return done


def _matrix(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and norms of a batch that has rows; its vectors are of one length."""
    if len(b.column(1).value_lengths().unique()) > 1:
        raise ValueError("vectors of several lengths")
    return b.column(0).to_numpy().astype(np.int64), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column(2).to_numpy()


def array_stats(rows: DataFrame, by: str, values: str, digits: int = 5) -> DataFrame:
    """Mean, spread, extremes, mean size, length and share of zeros of all numbers in arrays, and each group's share of all squares."""
    x = F.col("x").cast("double")
    each = rows.select(by, F.explode(values).alias("x"))
    stats = each.groupBy(by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(F.abs(x)).alias("abs_mean"), F.sum(x * x).alias("squares"), F.avg((x == 0).cast("double")).alias("zero_share"))
    total = stats.agg(F.sum("squares").alias("all_squares"))
    r = lambda c: F.round(c, digits)
    return stats.join(F.broadcast(total)).select(by, "n", *(r(F.col(c)).alias(c) for c in ("mean", "std", "low", "high", "abs_mean", "zero_share")), r(F.sqrt("squares")).alias("l2"), r(F.col("squares") / F.col("all_squares")).alias("share"))  # one row is broadcast
