"""Pruned posting lists against full products, and how much they leave out."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import postings, similarity


def plain_grams(text, sizes):
    out = []
    for w in (text or "").lower().split():
        padded = f" {w} "
        for n in sizes:
            if len(padded) >= n:
                out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
            elif n == sizes[0]:
                out.append(padded)
    return out


def plain(queries, candidates, k, sizes=(3, 4, 5), digits=6):
    counts = [[Counter(plain_grams(t, sizes)) for _, t in side] for side in (queries, candidates)]
    n, df = len(queries) + len(candidates), Counter(g for side in counts for c in side for g in c)

    def vector(c):
        v = {g: (1 + math.log(x)) * (math.log((1 + n) / (1 + df[g])) + 1) for g, x in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    sides, out = [[vector(c) for c in side] for side in counts], []
    for (q, _), a in zip(queries, sides[0]):
        scores = []
        for (c, _), b in zip(candidates, sides[1]):
            if shared := [g for g in a if g in b]:
                scores.append((-round(sum(a[g] * b[g] for g in shared), digits), c))
        out += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return out


def texts(rng, n, words):
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(n)]


@pytest.mark.parametrize("text", ["", None, "  ", "a", "Ab cd\tABC", "wörter und　mehr x\x1cy", "aaaaaa aaaa", "é" * 9])
@pytest.mark.parametrize("sizes", [(3, 4, 5), (2,), (4, 5), (6,)])
def test_grams_differ_where_texts_of_them_do(text, sizes):
    got = postings.grams(text, sizes)
    want = plain_grams((text or "").replace("\x1c", "\x02"), sizes)
    assert len(got) == len(want) and sorted(Counter(got.tolist()).values()) == sorted(Counter(want).values())


@pytest.mark.parametrize("k, block", [(1, 2_000), (3, 7)])
def test_equals_a_full_product(spark, k, block, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings.nearest, "__defaults__", (block,))
    monkeypatch.setattr(postings, "HELD", 50)
    rng = random.Random(4)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{i % 7}" for i in range(40)] + ["the", "and"] * 15
    queries, candidates = texts(rng, 25, words), texts(rng, 120, words)
    candidates += [(500 + i, candidates[i][1]) for i in range(20)]  # copies, whose ties go to the smaller id
    frames = [spark.createDataFrame(x, "id long, text string").repartition(3) for x in (queries, candidates)]
    want = plain(queries, candidates, k)
    for most in (10**9, 0):  # by posting lists, by joins
        got = sorted(tuple(r) for r in similarity.most_similar(*frames, k, most_grams=most).collect())
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
        assert [g[3] for g in got] == pytest.approx([w[3] for w in sorted(want)], abs=1.1e-6)


def test_edges(spark):
    kinds = "id long, text string"
    queries = spark.createDataFrame([(1, "some words here"), (2, None), (None, "some words"), (3, "zzz")], kinds)
    rows = spark.createDataFrame([(5, "words"), (5, "some words here"), (5, "some words here"), (None, "some words here"), (6, ""), (7, None), (8, "words here")], kinds)
    got = sorted(tuple(r) for r in similarity.most_similar(queries, rows, 3).collect())
    assert [g[:3] for g in got] == [(1, 1, 5), (1, 2, 8)] and got[0][3] == 1.0
    assert similarity.most_similar(queries, rows.filter("id > 99"), 3).count() == similarity.most_similar(queries.filter("id > 99"), rows, 3).count() == 0


def touched(spark, n):
    """Postings that one task touches for 30 queries against n documents, and those that a full product has."""
    rng = random.Random(9)
    rare = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('xyzq')}{i}" for i in range(3_000)]
    line = lambda: " ".join(["the", "and", "of", "in", "ing"] * 3 + [rng.choice(rare) for _ in range(8)])
    queries = [(i, line()) for i in range(30)]
    docs = [(i, line() if i % 10 else queries[i // 10 % 30][1] + " more") for i in range(n)]
    frames = [spark.createDataFrame(x, "id long, text string").coalesce(1) for x in (queries, docs)]
    df = postings.frequencies(frames[0].select("text").unionAll(frames[1].select("text")), (3, 4, 5))
    got = postings.nearest(*frames, 3, (3, 4, 5), 6, df, n + 30)
    lists = Counter(g for _, t in queries for g in set(plain_grams(t, (3, 4, 5))))
    return got.agg(F.max("touched")).first()[0], sum(lists[g] for _, t in docs for g in set(plain_grams(t, (3, 4, 5))))


def test_frequent_lists_are_not_read_once_scores_have_risen(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        (few, few_all), (many, many_all) = touched(spark, 600), touched(spark, 6_000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert many < 0.5 * many_all and few < few_all
    assert many <= 10 * few  # ten times the documents, at most ten times the postings


def test_best_of_a_query_stays_whole():
    """An index by itself: random vectors, pruned against all."""
    rng = np.random.default_rng(0)
    own = [(np.sort(rng.choice(50, 12, replace=False)), rng.random(12)) for _ in range(20)]
    q = postings.QueryIndex.of(list(range(20)), own, 50, 4, 6)
    q.reset()
    rows = [(i, np.sort(rng.choice(50, 10, replace=False)), rng.random(10)) for i in range(400)]
    for n, (i, p, w) in enumerate(rows):
        q.add(i, p, w)
        if n % 16 == 15:
            q.bound()
    for j, (p, w) in enumerate(own):
        dense = np.zeros(50)
        dense[p] = w
        want = sorted((-round(float(dense[p2] @ w2), 6), i) for i, p2, w2 in rows)[:4]
        assert list(zip((-q.best[j]).tolist(), q.best_ids[j].tolist())) == want


@pytest.mark.parametrize("letters", [1, 200, 500_000])
def test_words_grams_are_made_once_whatever_texts_they_stand_in(letters, monkeypatch):
    made, make = [], postings.word_grams
    monkeypatch.setattr(postings, "LETTERS", letters)
    monkeypatch.setattr(postings, "word_grams", lambda letter, start, length, sizes: made.append(len(start)) or make(letter, start, length, sizes))
    rng = random.Random(2)
    few = ["aaaa", "b", "Wörter", "x\x1cy", "\ud800z", "日本語", *(f"{rng.choice('klmn')}{i}o" for i in range(60))]
    rows = [None, "", " 　\n", *("\t".join(rng.choice(few) for _ in range(rng.randint(1, 30))) + " " for _ in range(400))]
    every = [Counter(plain_grams((t or "").replace("\x1c", "\x02"), (3, 4, 5))) for t in rows]
    seen = postings.Texts((3, 4, 5))
    got = [(place, tf) for some in postings.portions(rows) for place, tf in seen.of(some)]
    assert sum(made) == len({w for t in rows for w in (t or "").replace("\x1c", "\x02").lower().split()}) <= len(few)
    hashes = {}  # of grams, one each
    for t, c, (place, tf) in zip(rows, every, got, strict=True):
        assert len(place) == len(set(place.tolist())) == len(c) and sorted(tf.tolist()) == sorted(c.values())
        assert dict(zip(seen.places.met[place].tolist(), tf.tolist())) == Counter(postings.grams(t, (3, 4, 5)).tolist())
        hashes |= dict.fromkeys(seen.places.met[place].tolist())
    assert len(hashes) == len({g for c in every for g in c})
    known = np.sort(seen.places.met)
    again = postings.Texts((3, 4, 5), known)
    for (place, tf), (place2, tf2) in zip(got, (x for some in postings.portions(rows) for x in again.of(some)), strict=True):
        assert dict(zip(seen.places.met[place].tolist(), tf.tolist())) == dict(zip(known[place2].tolist(), tf2.tolist()))


def test_a_task_that_forgets_words_counts_the_same(spark, monkeypatch):
    rng = random.Random(5)
    rows = spark.createDataFrame([(" ".join(f"w{rng.randint(0, 99)}" for _ in range(20)),) for _ in range(300)], "text string").coalesce(2)
    want = Counter(g for r in rows.collect() for g in set(plain_grams(r.text, (3, 4))))
    monkeypatch.setattr(postings, "LETTERS", 100)
    for held in (8_000_000, 60):
        monkeypatch.setattr(postings, "HELD", held)
        assert sorted(r.df for r in postings.frequencies(rows, (3, 4)).collect()) == sorted(want.values())


@pytest.mark.parametrize("often, cells, loose", [(16, 4_000_000, 4.0), (16, 4_000_000, 1e9), (16, 64 * 9, 0.0), (10**9, 4_000_000, 1.5), (0, 0, 4.0)])
def test_common_grams_go_by_matrix_and_change_nothing(often, cells, loose, monkeypatch):
    for name, value in (("OFTEN", often), ("CELLS", cells), ("LOOSE", loose)):
        monkeypatch.setattr(postings, name, value)
    read, lists = [], postings.QueryIndex.postings
    monkeypatch.setattr(postings.QueryIndex, "postings", lambda self, at, w: read.append(int((self.start[at + 1] - self.start[at]).sum())) or lists(self, at, w))
    rng = np.random.default_rng(1)

    def vector(x=None):  # of 40 common grams of 600, and some others
        some = np.sort(np.concatenate([np.arange(40), 40 + rng.choice(560, 20, replace=False)]))
        w = np.where(some < 40, 0.5, 2.0) * rng.random(60)
        return some, w / np.sqrt(w @ w)

    own, rows = [vector() for _ in range(64)], [(i, *vector()) for i in range(500)]
    rows += [(1_000 + i, *own[i]) for i in range(20)] + [(2_000 + i, *own[i % 20]) for i in range(70)] + [(3_000, np.arange(600, 620), np.full(20, 0.2))]
    q = postings.QueryIndex.of(list(range(64)), own, 620, 3, 6)
    q.reset()
    for n, (i, p, w) in enumerate(rows):
        q.add(i, p, w)
        if n % 64 == 63:
            q.bound()
    q.settle()
    for j, (p, w) in enumerate(own):
        dense = np.zeros(620)
        dense[p] = w
        want = sorted((-round(float(dense[p2] @ w2), 6), i) for i, p2, w2 in rows if np.isin(p2, p).any())[:3]
        assert q.best_ids[j].tolist() == [i for _, i in want] and q.best[j].tolist() == pytest.approx([-s for s, _ in want], abs=1.1e-6)
    if often == 16 and cells > 10_000:
        assert sum(read) < 0.2 * 64 * 40 * len(rows)  # by lists alone, the common grams are 64 postings each
