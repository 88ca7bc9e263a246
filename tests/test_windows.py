"""Phrases by running sums against plain search."""

import random

import numpy as np
import pytest

from gradeloom.operators import joining, windows


def test_windows_hash_equal_words_alike():
    s = windows.Sums("x a b c\ty a  b\nc z")
    at = np.array([1, 5])
    for which in (0, 1):
        assert len(set(s.windows(at, 3, which).tolist())) == 1 and len(set(s.windows(np.arange(6), 3, which).tolist())) == 5
    assert s.windows(at, 2, 0)[0] != s.windows(at, 3, 0)[0] and s.windows(at, 3, 0)[0] != s.windows(at, 3, 1)[0]
    assert [windows.Sums(t).n for t in (None, "", " \n", "ä", "a\x1cb c")] == [0, 0, 0, 1, 2]


@pytest.mark.parametrize("anchor, block", [(5, 1_000_000), (2, 9), (1, 4)])
def test_pairs_equal_plain_search(spark, anchor, block):
    rng = random.Random(anchor)
    text = lambda n: " ".join(rng.choice("aaabbc") for _ in range(n))
    texts = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(40, None), (41, "a  b\tc"), (1, texts_of := "a b c a")]
    items = [(i, text(rng.randint(0, 9))) for i in range(60)] + [(60, None), (61, texts_of), (61, texts_of), (None, "a b")]
    got = joining.phrases(spark.createDataFrame(texts, "id long, text string").repartition(3), "id", "text", spark.createDataFrame(items, "item long, t string"), "item", "t", anchor, block)
    plain = lambda t: f" {' '.join((t or '').split())} "
    want = {(j, i) for i, t in texts for j, x in items if (x or "").split() and plain(x) in plain(t)}
    rows = [(r.item, r.id) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_no_items_and_no_texts(spark):
    some = spark.createDataFrame([(1, "a b")], "id long, text string")
    assert joining.phrases(some, "id", "text", spark.createDataFrame([(1, "")], "item string, t string").filter("item > 9"), "item", "t").count() == 0
    got = joining.phrases(some.filter("id > 9"), "id", "text", spark.createDataFrame([("x", "a b")], "item string, t string"), "item", "t")
    assert got.count() == 0 and got.columns == ["item", "id"]


def test_cost_is_linear_in_a_text():
    import time

    rng = random.Random(0)

    def seconds(n):
        text = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 50)) for _ in range(n))
        phrases = windows.Phrases([(2, np.sort(windows.Sums(text).windows(np.arange(50), 2, 0)), np.full(50, 6))], np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), None)
        began = time.process_time()
        phrases.found(text)
        return time.process_time() - began

    seconds(1_000)
    assert seconds(400_000) < 40 * max(seconds(40_000), 0.01)
