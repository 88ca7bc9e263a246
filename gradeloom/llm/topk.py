"""Exact top-k inner products by KD-trees per shard.

Candidates are hashed into shards of about ``shard_rows``; each shard has a KD-tree: median splits on the widest side down to leaves of ``LEAF_ROWS``, every
node with the tight box of its rows. A box bounds a query's score from above by the sum over components of max(q*lo, q*hi). A search starts at the
root with the query's kth score so far, always opens the open node with the largest bound, puts a node's children in its place, scores a leaf's
rows, and ends when no open node's bound reaches the kth score. Queries of a batch go down a tree together: each takes its own best node.

First every query is searched in its own shard. The kth score found there goes with the query to the other shards, where whole trees fall away under it.
A shard is one task's sequence of rows: its candidates, once, and after them the queries in batches, so that a task holds one tree and one batch, whatever
the table's size. Rows are written once with a number of their own, which tells a query's own row from every other one.

Components are floor(scale * x), scores integers. Numbers are floats while all products of a batch stay exact in them, and Python integers in the same
search where they don't; a score beyond a long's range counts as the end of that range.

Defined cases: vectors that are null, hold null or a non-finite component, or have a null id take no part. Every row is a candidate for every query
but its own row: rows with one id, identical ones too, are candidates for each other, and each is a query if the id is a query's. Vectors of different
lengths meet as if the shorter went on with zeros. Ties go to the smaller id. Fewer candidates than k: all of them. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BOOL, INT, LONG, batch_of, durable, schema, tidy

SHARD_ROWS, LEAF_ROWS, BATCH = 16_384, 128, 1_024
_EXACT = float(1 << 53)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class Tree:
    """A KD-tree in arrays: of each node its box and children (-1: a leaf), of each leaf its rows."""

    points: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    held: list[np.ndarray] = field(default_factory=list)
    #: Nodes opened and leaves scored, summed over queries.
    opened: int = 0
    scored: int = 0

    def build(self, leaf: int = LEAF_ROWS) -> Tree:
        todo = [(np.arange(len(self.points)), -1, 0)] if len(self.points) else []
        while todo:
            rows, parent, side = todo.pop()
            own = self.points[rows]
            me = len(self.children)
            if parent >= 0:
                pair = self.children[parent]
                self.children[parent] = (me, pair[1]) if side == 0 else (pair[0], me)
            self.low.append(own.min(0))
            self.high.append(own.max(0))
            self.children.append((-1, -1))
            split = len(rows) > leaf
            self.held.append(np.empty(0, np.int64) if split else rows)
            if split:
                axis = int(np.argmax(self.high[-1] - self.low[-1]))
                order = np.argsort(own[:, axis], kind="stable")
                half = len(rows) // 2
                todo += [(rows[order[:half]], me, 0), (rows[order[half:]], me, 1)]
        return self

    def bound(self, queries: np.ndarray, node: int) -> np.ndarray:
        return np.maximum(queries, 0) @ self.high[node] + np.minimum(queries, 0) @ self.low[node]

    def search(self, queries: np.ndarray, own: np.ndarray, kth: list[int | None], k: int) -> list[list[tuple[int, int]]]:
        """For each query its best (score, id), at most k, that can be among the k best: none below kth. Rows numbered ``own`` are left out."""
        m, nodes = len(queries), len(self.children)
        if not nodes or not m:
            return [[] for _ in range(m)]
        width = max(queries.shape[1], self.points.shape[1])
        largest = [max((abs(int(x)) for x in (a.min(), a.max())), default=0) if a.size else 0 for a in (queries, self.points)]
        points = self.points
        if width * max(1, largest[0]) * max(1, largest[1]) < _EXACT:
            kind = float
        else:  # the same search in Python integers
            kind, points, queries = object, points.astype(object), queries.astype(object)
            self.low, self.high = [x.astype(object) for x in self.low], [x.astype(object) for x in self.high]
        best: list[list[tuple[int, int]]] = [[] for _ in range(m)]
        none = -float("inf")
        floor = np.array([none if x is None else x for x in kth], kind)
        open_ = np.full((m, nodes), none, kind)
        open_[:, 0] = self.bound(queries, 0)
        active = np.arange(m)
        while len(active):
            at = np.argmax(open_[active], 1)
            top = open_[active, at]
            more = (top > none) & (top >= floor[active])  # an equal bound may hide a smaller id
            active, at = active[more], at[more]
            for node in np.unique(at):
                q = active[at == node]
                open_[q, node] = none
                left, right = self.children[node]
                self.opened += len(q)
                if left >= 0:
                    for child in (left, right):
                        open_[q, child] = self.bound(queries[q], child)
                    continue
                self.scored += len(q)
                rows = self.held[node]
                scores = queries[q] @ points[rows].T
                hit = np.flatnonzero((scores >= floor[q][:, None]).any(1))
                for i, s in zip(q[hit], scores[hit], strict=True):
                    fit = np.flatnonzero((s >= floor[i]) & (self.rows[rows] != own[i]))
                    if len(fit):
                        best[i] = sorted([*best[i], *((-max(_LEAST, min(_MOST, int(s[j]))), int(self.ids[rows[j]])) for j in fit)])[:k]
                        if len(best[i]) == k:
                            floor[i] = max(floor[i], -best[i][-1][0])
        return [[(-s, i) for s, i in b] for b in best]


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of 64-bit integers as rows of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width), np.int64)
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def numbers(points: np.ndarray) -> np.ndarray:
    """Floats, unless some component isn't exact in them."""
    return points.astype(float) if not points.size or max(abs(int(points.min())), abs(int(points.max()))) < _EXACT else points.astype(object)


FOUND = schema(__row=LONG, query_id=LONG, vec_id=LONG, score=LONG)


def answers(tree: Tree, rows: np.ndarray, ids: np.ndarray, vectors: pa.Array | pa.ChunkedArray, kth: list[int | None], k: int, width: int) -> pa.RecordBatch:
    """What queries (rows, ids, vectors) find in a tree."""
    asked = numbers(matrix(vectors, width))
    out: list[tuple[int, int, int, int]] = []
    for i in range(0, len(rows), BATCH):
        part = slice(i, i + BATCH)
        for r, q, found in zip(rows[part].tolist(), ids[part].tolist(), tree.search(asked[part], rows[part], kth[part], k), strict=True):
            out += [(r, q, vec, score) for score, vec in found]
    return batch_of(FOUND, dict(zip(("__row", "query_id", "vec_id", "score"), map(list, zip(*out, strict=True)) if out else ([],) * 4, strict=True)))


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of (vec_id, embedding) for each row where ``is_query`` holds."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    usable = vectors.select(F.col("vec_id").cast(LONG).alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).cast(BOOL).alias("__ask")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast(LONG))
    rows = durable(usable.select("vec_id", "__ask", v.alias("v"), F.monotonically_increasing_id().alias("__row")))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width, shards = max(1, width), max(1, -(-n // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("__row", F.lit(3)), F.lit(shards)).cast(INT))

    def tree_of(table: pa.Table) -> Tree:
        return Tree(numbers(matrix(table["v"], width)), table["vec_id"].to_numpy(), table["__row"].to_numpy()).build(leaf_rows)

    def at_home(group: pa.Table) -> pa.Table:
        asks = group.filter(group["__ask"])
        found = answers(tree_of(group), asks["__row"].to_numpy(), asks["vec_id"].to_numpy(), asks["v"], [None] * asks.num_rows, k, width)
        return pa.Table.from_batches([found])

    home = durable(rows.groupBy("shard").applyInArrow(at_home, FOUND))
    found = home
    if shards > 1:
        kth = home.groupBy("__row").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        asks = rows.filter("__ask").join(kth, "__row", "left").select(F.col("shard").alias("__home"), "__row", "vec_id", "v", "kth")
        everywhere = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("__home"))
        asks = asks.withColumn("shard", F.explode(everywhere)).select("shard", F.lit(1).alias("__last"), "__row", "vec_id", "v", "kth")
        candidates = rows.select("shard", F.lit(0).alias("__last"), "__row", "vec_id", "v", F.lit(None).cast(LONG).alias("kth"))
        lines = candidates.unionAll(asks).repartition(shards, "shard").sortWithinPartitions("shard", "__last")

        def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A shard's candidates come first, then its queries; shards follow each other.
            now, parts, tree = None, [], None
            for b in batches:
                shard, last = b.column("shard").to_numpy(), b.column("__last").to_numpy()
                edges = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(last) != 0)) + 1).tolist(), b.num_rows]
                for i, j in zip(edges, edges[1:], strict=False):
                    if i == j:
                        continue
                    piece = b.slice(i, j - i)
                    if shard[i] != now:
                        now, parts, tree = int(shard[i]), [], None
                    if not last[i]:
                        parts.append(piece)
                        continue
                    if tree is None:
                        tree, parts = tree_of(pa.Table.from_batches(parts, piece.schema)), []
                    yield answers(tree, piece.column("__row").to_numpy(), piece.column("vec_id").to_numpy(), piece.column("v"), piece.column("kth").to_pylist(), k, width)
            tidy()

        found = home.unionByName(lines.mapInArrow(elsewhere, FOUND))
    rank = F.row_number().over(Window.partitionBy("__row").orderBy(F.desc("score"), "vec_id"))  # k rows a query and shard at most
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast(INT).alias("rank"), "vec_id", "score")


def op3(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


#: Rows are told apart by a number, so that rows with one id are candidates for each other, as they are above.
OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n AS n, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
