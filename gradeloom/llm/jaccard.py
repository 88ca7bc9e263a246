"""N-gram Jaccard join by MinHash banding.

A document's n-grams are the runs of ``n`` words (lower-cased A-Z, split at white space); a text of fewer words has its whole run of words as
its one n-gram, a text without words has none and no links. Two documents are linked if their sets' Jaccard similarity is at least
``threshold``. Bands and rows are chosen so that a pair at the threshold meets in a band with probability ``recall``; pairs above it meet
more surely. What meets is verified on the full sets (64-bit hashes of n-grams), never on signatures.

How it runs:

1. One pass writes each document's set digest (16 bytes), band hashes and a 128-bit hash of id and text. Documents with equal sets are one node
   with a weight; a group of copies of any size is combined in each task before it is shuffled.
2. Nodes are shuffled on band hashes. Buckets with one node go; of buckets with the same nodes one stays.
3. Each remaining bucket is verified in blocks of nodes against blocks of nodes by matrix products over shared n-grams. A pair that
   meets in several buckets is counted in that of its first common band only. A task returns counts of links and edges of a spanning forest,
   so its output is linear in its nodes, and pairs are never rows.
4. Connected components by alternating large and small stars, written to the shared folder each round.

The n-grams of nodes that meet others are read again from the texts, which are found by their hashes, never by their place in a scan: each task
gives each text once, however many copies it has. Nothing of a document is sent to the driver.

Result, one row a document: class_id (smallest doc_id of the connected component), n_links (documents with similarity at or above the threshold, copies
counted one by one). Defined cases: null and empty texts, and texts of white space, have no links and are classes of their own; repeated rows link
each other; null ids count as documents and are a class's id only if it has no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import INT, LONG, batch_of, durable, few_rows_a_batch, mix64, schema, small_batches, texts, word_hashes

WORDS, THRESHOLD, RECALL, ROWS, BLOCK = 5, 0.8, 0.9999, 4, 256
#: Bytes of keys that may be broadcast.
BROADCAST_BYTES = 8 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` rows with which a pair at the threshold is met with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def grams(text: str, n: int = WORDS) -> np.ndarray:
    """The sorted set of a text's n-grams, hashed."""
    h = word_hashes(text)
    if not len(h):
        return h
    size = min(n, len(h))
    with np.errstate(over="ignore"):
        g = h[: len(h) - size + 1].copy()
        for j in range(1, size):
            g = g * _STEP + h[j : len(h) - size + 1 + j]
        return np.unique(mix64(g + np.uint64(size)))


def digest(g: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return int(mix64(g).sum(dtype=np.uint64)).to_bytes(8, "big") + int(np.bitwise_xor.reduce(mix64(g * _STEP + np.uint64(len(g))))).to_bytes(8, "big")


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20_240_517).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def band_hashes(g: np.ndarray, a: np.ndarray, rows: int) -> np.ndarray:
    """The hash of each band of a set's MinHash signature."""
    low = np.full(len(a), np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for i in range(0, len(g), 4096):
            m = g[i : i + 4096, None] * a[None, :]
            m ^= m >> np.uint64(32)
            low = np.minimum(low, m.min(0))
        low = low.reshape(-1, rows)
        out = np.arange(1, len(low) + 1, dtype=np.uint64)
        for r in range(rows):
            out = mix64(out * _STEP + low[:, r])
    return out


def text_hash() -> list:
    """128 bits of a text; null and empty are one."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(F.lit(i), text).alias(f"t{i}") for i in (1, 2)]


def row_key() -> list:
    """128 bits of a row's id and text, which tell it from all rows but its own repetitions; a null id is one of its own."""
    return [F.xxhash64(F.lit(i), F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias(f"k{i}") for i in (1, 2)]


def signed(docs: DataFrame, n: int, threshold: float, recall: float, rows: int) -> DataFrame:
    """doc_id, t1, t2 (text hash), k1, k2 (row key), s (digest; null without words) and bands of each document."""
    chosen = docs.select("doc_id", *text_hash(), *row_key(), "text")
    names = chosen.columns[:-1]
    kinds = T.StructType([*chosen.schema.fields[:-1], T.StructField("s", T.BinaryType()), T.StructField("bands", T.ArrayType(LONG))])
    a = multipliers(bands_for(threshold, recall, rows) * rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 4 << 20):
            s, bands = [], []
            for t in texts(b.column("text")):
                g = grams(t, n)
                s.append(digest(g) if len(g) else None)
                bands.append(band_hashes(g, a, rows).view(np.int64) if len(g) else None)
            yield batch_of(kinds, {c: b.column(c) for c in names} | {"s": s, "bands": bands})

    return chosen.mapInArrow(sign, kinds)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the sets of a with those of b, by products of 0/1 matrices over columns that both sides have."""
    if len(a) * len(b) <= 4:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], float)
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)

    def places(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        has = both[at] == flat
        return np.repeat(np.arange(len(sets)), [len(x) for x in sets])[has], at[has]

    if not len(both):
        return out
    (ra, ca), (rb, cb) = places(flat_a, a), places(flat_b, b)
    for i in range(0, len(both), 8192):
        width = min(8192, len(both) - i)
        one, two = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        for m, r, c in ((one, ra, ca), (two, rb, cb)):
            own = (c >= i) & (c < i + width)
            m[r[own], c[own] - i] = 1
        out += one @ two.T
    return out


def verified(left: dict, right: dict | None, bucket: int, threshold: float) -> list[tuple[bytes, int, bytes]]:
    """Node, links and root (of a spanning forest) of what is linked: pairs of left and right, or pairs within left.

    A side has keys, sets, weights and bands (a bucket or 0 for each band).
    """
    other = right or left
    inter = overlaps(left["sets"], other["sets"])
    na, nb = (np.array([len(x) for x in side["sets"]], float) for side in (left, other))
    linked = inter >= threshold * (na[:, None] + nb[None, :] - inter) - 1e-6
    if right is None:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    if len(i):
        x, y = left["bands"][i], other["bands"][j]
        same = (x == y) & (x != 0)
        first = x[np.arange(len(i)), np.argmax(same, 1)]
        here = first == bucket
        i, j = i[here], j[here]
    if not len(i):
        return []
    keys = left["keys"] + (other["keys"] if right else [])
    j_at = j + (len(left["keys"]) if right else 0)
    weights = np.array(left["weights"] + (other["weights"] if right else []), np.int64)
    links = np.zeros(len(keys), np.int64)
    np.add.at(links, i, weights[j_at])
    np.add.at(links, j_at, weights[i])
    parent = list(range(len(keys)))

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for p, q in zip(i.tolist(), j_at.tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            p, q = (p, q) if keys[p] < keys[q] else (q, p)
            parent[q] = p
    return [(keys[v], int(links[v]), keys[find(v)]) for v in np.flatnonzero(links)]


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node of its component) of an undirected graph (a, b), by alternating large and small stars."""
    edges = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # Large star: each node's larger neighbours go to the smallest of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The minima are written first: the join that follows then has a shuffle of its own, which adaptive execution can split at a hub.
        low = durable(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = durable(large)
        # Small star: each node's smaller neighbours, and itself, go to the smallest of them.
        low = durable(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = durable(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def joined(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, k1, k2, s) and nodes (s, rep, weight, links, root)."""
    few_rows_a_batch(docs.sparkSession)
    signs = durable(signed(docs, n, threshold, recall, rows))
    nodes = signs.filter("s IS NOT NULL").groupBy("s").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.min(F.struct("t1", "t2")).alias("at"), F.max("bands").alias("bands"))
    nodes = durable(nodes)
    spread = nodes.select("s", F.posexplode("bands").alias("band", "bucket"))
    # Buckets with more than one node; of those with the same nodes, the smallest stands for all.
    size = spread.groupBy("bucket").agg(F.count("*").alias("size"), F.sum(F.xxhash64("s").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64("s", F.lit(1)).cast("decimal(38,0)")).alias("y")).filter("size > 1")
    kept = size.groupBy("size", "x", "y").agg(F.min("bucket").alias("keeps"))
    size = size.join(kept, ["size", "x", "y"]).select("bucket", "keeps", "size")
    members = durable(spread.join(size, "bucket").select("s", "band", "keeps", "size"))
    count = bands_for(threshold, recall, rows)
    # Each meeting node once, with its bucket in each band (0: none), and its n-grams read from one of its documents.
    by_band = members.groupBy("s").agg(F.collect_list(F.struct("band", "keeps")).alias("in"))  # at most a row a band
    meeting = by_band.join(nodes.select("s", "weight", "at"), "s")
    meeting = durable(meeting.select("s", "weight", "at", "in"))
    wanted = meeting.select("at.t1", "at.t2", F.col("s").alias("__s"))
    small = meeting.count() * 40 <= BROADCAST_BYTES
    source = docs.select("text", *text_hash()).join(F.broadcast(wanted) if small else wanted, ["t1", "t2"]).select("__s", "text")
    kinds = T.StructType([T.StructField("__s", T.BinaryType()), T.StructField("grams", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # 16 bytes a text that others meet, of those that this task reads
        for b in small_batches(batches, 4 << 20):
            s_, g = [], []
            for key, t in zip(b.column("__s").to_pylist(), b.column("text").to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    s_.append(key)
                    g.append(grams(t or "", n).tobytes())
            yield batch_of(kinds, {"__s": s_, "grams": g})

    once = source.mapInArrow(read, kinds).groupBy("__s").agg(F.min("grams").alias("grams"))
    full = meeting.join(once, F.col("s") == F.col("__s")).select("s", "weight", "in", "grams")
    full = full.withColumn("bands", F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.coalesce(F.element_at(F.map_from_entries("in"), k), F.lit(0))))
    full = durable(full.select("s", "weight", "bands", "grams"))
    # A row for each bucket, pair of blocks and node.
    where = members.groupBy("s", "keeps").agg(F.max("size").alias("size")).withColumn("blocks", F.ceil(F.col("size") / block).cast(INT))
    where = where.withColumn("own", F.pmod(F.xxhash64("s", F.lit(2)), F.col("blocks")).cast(INT)).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    where = where.select("s", "keeps", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own")
    tasks = where.join(full, "s").repartition("keeps", "i", "j").sortWithinPartitions("keeps", "i", "j", "s")
    out = T.StructType([T.StructField("s", T.BinaryType()), T.StructField("links", LONG), T.StructField("root", T.BinaryType())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple, group: list[tuple]) -> list[tuple[bytes, int, bytes]]:
            bucket, i, j = key
            sides = []
            for block_ in (i, j):
                own = [r for r in group if r[0] == block_]
                if not own:  # hashing left one of the blocks empty
                    return []
                sides.append({"keys": [r[1] for r in own], "weights": [r[2] for r in own], "bands": np.array([r[3] for r in own], np.int64), "sets": [np.frombuffer(r[4], np.uint64) for r in own]})
            return verified(sides[0], None if i == j else sides[1], bucket, threshold)

        key, group, found = None, [], []
        for b in small_batches(batches, 8 << 20):
            for bucket, i, j, own, s, weight, bands, g in zip(*(b.column(c).to_pylist() for c in ("keeps", "i", "j", "own", "s", "weight", "bands", "grams")), strict=True):
                if (bucket, i, j) != key:
                    if len(group) > 1:
                        found += done(key, group)
                    key, group = (bucket, i, j), []
                group.append((own, s, weight, bands, g))
            if len(found) > 20_000:
                yield batch_of(out, dict(zip(("s", "links", "root"), map(list, zip(*found, strict=True)), strict=True)))
                found = []
        if len(group) > 1:
            found += done(key, group)
        if found:
            yield batch_of(out, dict(zip(("s", "links", "root"), map(list, zip(*found, strict=True)), strict=True)))

    links = durable(tasks.mapInArrow(verify, out))
    roots = components(links.select(F.col("s").alias("a"), F.col("root").alias("b")))
    total = links.groupBy("s").agg(F.sum("links").alias("links"))
    whole = nodes.join(total, "s", "left").join(roots.withColumnRenamed("node", "s"), "s", "left")
    whole = whole.select("s", "rep", "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "s").alias("root"))
    return signs.select("doc_id", "k1", "k2", "s"), durable(whole)


def classes(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    rows, nodes = joined(docs, **parameters)
    ids = nodes.groupBy("root").agg(F.min("rep").alias("class_id"))
    by_node = nodes.join(ids, "root").select("s", "class_id", "links")
    result = rows.join(by_node, "s", "left")
    return result.select("doc_id", F.when(F.col("s").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast(LONG).alias("n_links"))


def one_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when of each class one row with the smallest doc_id stays (of several, that with the smallest key).

    Rows are found again by the hash of id and text. Of a row that stands several times, its id and text being the same, any one stays.
    """
    rows, nodes = joined(docs, **parameters)
    some = rows.filter("s IS NOT NULL").groupBy("s", "doc_id", "k1", "k2").agg(F.count("*").alias("n"))
    some = durable(some.join(nodes.select("s", "root"), "s").select("root", "doc_id", "k1", "k2", "n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "k1", "k2", "n")).alias("f")
    stays = durable(some.groupBy("root").agg(first).select("f.k1", "f.k2", "f.n"))
    # What goes: rows whose key isn't one that stays, and rows that repeat one that does, of which one comes back.
    gone = durable(some.select("k1", "k2").join(stays.filter("n = 1"), ["k1", "k2"], "left_anti").distinct())
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in own.items()), *row_key())
    small = lambda keys: F.broadcast(keys) if keys.count() * 16 <= BROADCAST_BYTES else keys
    kept = keyed.join(small(gone), ["k1", "k2"], "left_anti")
    repeated = stays.filter("n > 1").select("k1", "k2")
    if not repeated.isEmpty():
        kept = kept.unionByName(keyed.join(small(repeated), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    return kept.select(*(F.col(x).alias(c) for c, x in own.items()))


def op4(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
