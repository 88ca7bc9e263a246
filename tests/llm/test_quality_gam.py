"""The quality model: its features, trees and tables against plain loops, pairs that no single number shows, held-out labels, edges."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import quality_gam as Q

from .conftest import EDGES


def plain(text):
    """The features by words and characters, one at a time."""
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return [float(np.log1p(len(raw)))] + [0.0] * 21
    n, low = len(words), [bytes(c + 32 if 65 <= c < 91 else c for c in w) for w in words]
    is_mark = lambda c: not (c >= 128 or bytes([c]).isalnum() or c in b".,;:?!'\"()-" or c in b"\t\n\x0b\x0c\r ")
    letters, capitals = sum(97 <= c < 123 for c in raw), sum(65 <= c < 91 for c in raw)
    share = lambda test: sum(map(test, raw)) / len(raw)
    sizes, lines = [len(w) for w in words], [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(len(raw)), np.log(n), np.mean(sizes), np.std(sizes), len(set(low)) / n, max(map(low.count, set(low))) / n, sum(a == b for a, b in zip(low, low[1:])) / (n - 1) if n > 1 else 0.0,
        capitals / max(1, letters + capitals), share(lambda c: 48 <= c < 58), share(is_mark), share(lambda c: c in b".,;:?!'\"()-"), share(lambda c: c in b"\t\n\x0b\x0c\r "), share(lambda c: c >= 128),
        sum(is_mark(w[-1]) for w in words) / n, sum(w[-1:] == b"!" for w in words) / n, sum(len(w) == 1 and is_mark(w[0]) for w in words) / n, sum(sum(65 <= c < 91 for c in w) > 1 for w in words) / n, sum(s <= 3 for s in sizes) / n,
        len(raw) / len(lines), 1 - len(set(lines)) / len(lines), sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines), len(set(raw)),
    ]


@pytest.mark.parametrize("text", ["", " \n\t", "One.", "A a A b!\n\nA a A b!\nÉté | 12 x***\x1c", "WORD WORD!! | | x$ y\r\n" * 40 + "end", *(e[1] or "" for e in EDGES)])
def test_features_equal_loops(text):
    assert Q.features(text.encode()) == pytest.approx(plain(text), abs=1e-9)


def test_trees_take_the_best_cut():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        g, h = rng.normal(size=n).round(2), rng.random(n).round(2) + 0.1
        every = [(Q.gain(g[:k].sum(), h[:k].sum(), 1.0) + Q.gain(g[k:].sum(), h[k:].sum(), 1.0) - Q.gain(g.sum(), h.sum(), 1.0), k) for k in range(1, n) if min(h[:k].sum(), h[k:].sum()) >= 0.5]
        won, at = Q.split(g, h, 1.0, 0.5)
        assert won == pytest.approx(max([0.0, *(float(e[0]) for e in every)]), abs=1e-9)
        steps = Q.tree(g, h, 2, 1.0, 0.5)
        for part in (slice(0, at), slice(at, None)) if at else (slice(None),):
            assert steps[part] == pytest.approx(np.full(len(g[part]), -g[part].sum() / (h[part].sum() + 1.0)))


def test_pair_trees_take_the_best_of_all_quadrants():
    rng = np.random.default_rng(4)
    for _ in range(30):
        shape = tuple(rng.integers(1, 5, 2))
        g, h = rng.normal(size=shape), rng.random(shape) + 0.6
        best = 0.0
        for a, b in ((g, h), (g.T, h.T)):
            for k in range(1, len(a)):
                won = -Q.gain(g.sum(), h.sum(), 1.0)
                for side in (slice(0, k), slice(k, None)):
                    p, q = a[side].sum(0), b[side].sum(0)
                    won += max(Q.gain(p[:c].sum(), q[:c].sum(), 1.0) + (Q.gain(p[c:].sum(), q[c:].sum(), 1.0) if c < len(p) else 0) for c in range(1, len(p) + 1))
                best = max(best, float(won))
        table, won = Q.pair_tree(g, h, 1.0, 0.0)
        assert won == pytest.approx(best, abs=1e-9) and table.shape == shape
        # What the table really gains is what it says.
        leaves = {v: table == v for v in np.unique(table)}
        assert sum(Q.gain(g[m].sum(), h[m].sum(), 1.0) for m in leaves.values()) - Q.gain(g.sum(), h.sum(), 1.0) == pytest.approx(won, abs=1e-6)


def test_bins_are_near_equal():
    x = np.random.default_rng(1).normal(size=1_000)
    counts = np.bincount(np.searchsorted(Q.quantile_edges(x, 10), x, "right"))
    assert len(counts) == 10 and counts.min() >= 90 and counts.max() <= 110
    assert list(Q.quantile_edges(np.zeros(5), 8)) == [] and list(Q.quantile_edges(np.array([0.0, 1, 1, 1]), 8)) == [0.5]


def rows_of_two_kinds(n=3_000):
    rng = np.random.default_rng(3)
    x = rng.random((n, 4)).round(3)
    return x, ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float), np.ones(n)


def test_a_pair_that_no_single_feature_shows():
    x, y, w = rows_of_two_kinds()
    alone, both = Q.fit(x, y, w, pairs=0), Q.fit(x, y, w, pairs=2)
    assert both.pairs[0] == (0, 2)
    new = np.random.default_rng(8).random((2_000, 4))
    want = (new[:, 0] > 0.5) ^ (new[:, 2] > 0.5)
    right = lambda m: ((m.scores(new) >= 0.5) == want).mean()
    assert right(alone) < 0.65 and right(both) > 0.93


def test_scores_are_sums_of_table_entries():
    x, y, w = rows_of_two_kinds(800)
    m = Q.fit(x, y, w)
    for r, z, why in zip(x[:50], m.log_odds(x[:50]), m.reasons(x[:50], 99), strict=True):
        place = lambda edges, v: sum(v >= e for e in edges)
        want = m.intercept + sum(t[place(e, v)] for e, t, v in zip(m.edges, m.tables, r, strict=True))
        want += sum(t[place(m.pair_edges[i], r[i]), place(m.pair_edges[j], r[j])] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
        assert z == pytest.approx(want, abs=1e-9) and m.intercept + sum(v for _, v in why) == pytest.approx(want, abs=1e-9)
    # Tables are centred: the intercept is the mean.
    assert np.mean(m.log_odds(x)) == pytest.approx(m.intercept, abs=1e-9)


def test_more_rounds_lower_the_loss():
    x, y, w = rows_of_two_kinds(600)
    losses = [Q.log_loss(Q.fit(x, y, w, rounds=r).log_odds(x), y, w) for r in (0, 2, 10, 60)]
    assert losses == sorted(losses, reverse=True) and losses[0] > losses[-1]


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op11(spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    held = [i for i in labels if rows[i].held_out]
    assert len(held) > 80 and np.mean([rows[i].predicted == labels[i] for i in held]) > 0.97
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_labels_of_the_held_out_fold_and_other_columns_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    keep = Q.crc_fold("doc_id", 3) != 1
    other = labels.withColumn("quality", F.when(keep, F.col("quality")).otherwise(1 - F.col("quality")))
    renamed = docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "x": F.lit(1), "__y": F.lit(1)})
    a, b = ({r.doc_id: r.score for r in Q.score(d, Q.train(d, t, keep)).collect()} for d, t in ((docs, labels), (renamed, other)))
    assert a == b


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (8, 0), (7, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = Q.train(edge_docs, labels, F.lit(True))
    got = Q.score(edge_docs, model).collect()
    assert len(got) == len(EDGES) and all(0 < r.score < 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1  # null and empty
    assert Q.score(no_docs, model).count() == 0
    assert Q.train(no_docs, labels, F.lit(True)) is None and Q.train(edge_docs, labels.filter("doc_id > 100"), F.lit(True)) is None
    assert {(r.score, r.predicted) for r in Q.score(edge_docs, None).collect()} == {(0.5, 1)}
    ones = Q.score(edge_docs, Q.train(edge_docs, labels.filter("quality = 1"), F.lit(True))).collect()
    assert {r.predicted for r in ones} == {1}


def test_the_sample_is_bounded_and_keeps_rare_labels(spark):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.when(F.col("id") % 50 == 0, F.lit("$$$ ### *** ")).otherwise(F.lit("more")), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 50 != 0).cast("int").alias("quality"))
    seen = []
    plain_fit = Q.fit
    try:
        Q.fit = lambda x, y, w, **k: seen.append((len(y), y.mean(), w @ y / w.sum())) or plain_fit(x, y, w, **k)
        model = Q.train(docs, labels, F.lit(True), sample=400)
    finally:
        Q.fit = plain_fit
    n, share, real = seen[0]
    assert 380 < n < 560 and share < 0.9 and real == pytest.approx(0.98, abs=1e-6)
    got = Q.score(docs.join(labels, "doc_id").drop("quality"), model).join(labels, "doc_id")
    assert got.filter("predicted <> quality").count() == 0
