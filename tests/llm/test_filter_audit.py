"""The audit of filters against a plain loop over rows, orders and steps."""

from itertools import permutations

import numpy as np
import pytest

from gradeloom.llm import filter_audit

from .conftest import documents


def plain(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    docs = [(i, t or "", p or "") for i, t, p in docs]
    rows = []
    for i, t, p in docs:
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in t).split(" ") if x]
        copies = [j for j, u, _ in docs if u == t and j is not None]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j < i for j in copies)}
        own = [x for x in labels if x[0] == i and i is not None]
        rows.append((p, {c for c, f in fails.items() if f}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        mine, removed = [r for r in rows if r[0] == part], {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                removed.setdefault(c, []).append(len(gone))
                fail = sum(c in r[1] for r in mine)
                out[part, order, step] = [len(left), len(gone), fail - len(gone), sum(r[1] == {c} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), c]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = sum(removed[v[-1]])
    return {k: tuple(v) for k, v in out.items()}


LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [
    (1, LONG, "en", "a"), (2, LONG, "de", "a"), (2, LONG, "en", "a"), (None, LONG, "en", "a"), (None, None, None, "a"), (0, "", "", "a"), (7, None, "en", "a"), (8, "a " * 300, "en", "a"),
    (8, "a " * 300, "en", "a"), (9, "A " * 200, "de", "a"), (10, LONG + "\x0b| W", "de", "a"), (11, "A b b b", None, "a"), (12, "x" * 5_000, "de", "a"), (13, LONG + "É", "de", "a"), (14, "w W w w " * 100, "en", "a"),
    (15, "ABC" + "é" * 97 + LONG.lower(), "en", "a"), (3, "a " * 300, "en", "a"), (16, LONG.replace(" ", "\x0c"), "en", "a"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (8, 1, 1), (8, None, 0), (10, 1, 0), (None, 1, 1), (99, 1, 1), (9, 0, 1)]


@pytest.mark.parametrize("parts", [1_000, 3])
def test_audit_equals_loops(spark, parts):
    """With three parts the copies, and the ids that repeat, go by broadcast."""
    docs = documents(spark, DOCS).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels, parts)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r[:3]): tuple(r[3:]) for r in got.collect()} == plain([d[:3] for d in DOCS], LABELS)


def test_audit_of_nothing(spark, no_docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(no_docs, labels).count() == 0
    got = filter_audit.audit(documents(spark, DOCS), labels.filter("doc_id > 1000")).collect()
    assert len(got) == 120 * 5 * 3 and not any(r.good_lost or r.toxic_lost for r in got)


def test_popcounts_equal_counts():
    rng = np.random.default_rng(3)
    for n in (1, 7, 8, 9, 1_001):
        part, fails, labels = rng.integers(0, 3, n), rng.integers(0, 32, n).astype(np.int32), [rng.random(n) < 0.5 for _ in range(2)]
        got = filter_audit.popcounts(part, fails, labels, 3)
        for p in range(3):
            for s in range(32):
                left = (part == p) & (fails & s == 0)
                assert got[p, s].tolist() == [left.sum(), (left & labels[0]).sum(), (left & labels[1]).sum()]


def test_one_words_bytes():
    assert [filter_audit.failures(t.encode()) for t in ("", LONG, "a\x1cb " * 200, "a|" + LONG)] == [1, 0, 2, 8]
