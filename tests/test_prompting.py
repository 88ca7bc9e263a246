"""Batches of prompts and label masks against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import chat as C
from gradeloom.operators import packing, splitting

TEXTS = ["", "a", "wörter für käse", "日本語のテキスト", "a😀b😀", "x" * 300, "é\n<|im_end|>"]


def test_next_fit():
    assert packing.next_fit([], 10) == [] and packing.next_fit([99, 1, 1, 9, 10, 10], 20) == [0, 1, 1, 2, 2, 3]
    rng = random.Random(2)
    for _ in range(100):
        tokens, limit = [rng.randint(1, 30) for _ in range(rng.randint(1, 40))], rng.randint(5, 90)
        got = packing.next_fit(tokens, limit)
        assert got == sorted(got) and set(got) == set(range(got[-1] + 1))
        for b in set(got):
            own = [t for t, x in zip(tokens, got) if x == b]
            after = next((t for t, x in zip(tokens, got) if x == b + 1), None)
            assert len(own) == 1 or len(own) * max(own) <= limit
            assert after is None or (len(own) + 1) * max([*own, after]) > limit  # the next row really had no room


@pytest.mark.parametrize("one_task", [500_000, 0])
def test_packed(spark, one_task, monkeypatch):
    monkeypatch.setattr(splitting, "ONE_TASK", one_task)
    rng = random.Random(5)
    rows = [(i // 2, i % 2, rng.choice([None, 0, 500, *range(1, 60)]), "x") for i in range(300)]
    got = packing.packed(spark.createDataFrame(rows, "a long, b long, size long, batch string").repartition(5), ["a", "b"], F.col("size"), 200)
    found = sorted((r.a, r.b, r.tokens, r.chunk, r.batch) for r in got.collect())
    want, before, chunks = [], 0, {}
    for a, b, size, _ in rows:
        size = max(1, size or 1)
        chunks.setdefault(before // 200, []).append((a, b, size))
        before += size
    for chunk, own in chunks.items():
        want += [(*r, chunk, x) for r, x in zip(own, packing.next_fit([r[2] for r in own], 200))]
    assert found == sorted(want)
    for r in packing.budgets(got, ["chunk", "batch"], 100, 150, 10).collect():
        own = [x for x in found if x[3:] == (r.chunk, r.batch)]
        longest = max(x[2] for x in own)
        assert (r.prompts, r.longest, r.padded, r.budget) == (len(own), longest, len(own) * longest, max(0, min(100, 150 - longest - 10)))
    assert packing.packed(got.filter("a < 0").withColumn("size", F.lit(1)), ["a", "b"], F.col("size"), 9).count() == 0


def cut(text, rng):
    n, out = len(text.encode()), []
    while n:
        out.append(min(n, rng.randint(1, 6)))
        n -= out[-1]
    return out


def test_character_spans():
    rng = random.Random(1)
    for text in TEXTS:
        lengths, at = cut(text, rng), 0
        starts, ends = C.character_spans(text, np.array(lengths, np.int64))
        owner = [i for i, ch in enumerate(text) for _ in ch.encode()]
        for n, a, z in zip(lengths, starts, ends, strict=True):
            assert (a, z) == (owner[at], owner[at + n - 1] + 1)
            at += n
    for lengths in ([2], [1, 0, 2], [4]):
        with pytest.raises(ValueError):
            C.character_spans("abc", np.array(lengths))


@pytest.mark.parametrize("last", ["assistant", "user", None])
def test_rows_and_masks(spark, last):
    rng = random.Random(3)
    rows = []
    for i, text in enumerate([*TEXTS, None]):
        messages = [("system", "Sei kurz ö."), ("user", rng.choice(TEXTS)), ("assistant", rng.choice(TEXTS)), ("user", "and?"), (last, text)][i % 3 :]
        whole = "".join(f"<|im_start|>{r or ''}\n{c or ''}<|im_end|>\n" for r, c in messages)
        lengths = cut(whole, rng)
        rows.append((i, messages, lengths, list(range(100, 100 + len(lengths))), whole))
    kinds = "i int, messages array<struct<role:string,content:string>>, lengths array<int>, ids array<int>, whole string"
    df = spark.createDataFrame(rows, kinds)
    m = F.col("messages")
    with_text = df.withColumns({"text": C.rendered(m), "start": C.answer_start(m), "spans": C.spans(m), "asked": C.rendered(F.slice(m, 1, F.size(m) - 1), True)})
    got = with_text.withColumn("labels", C.labels(F.col("ids"), C.token_spans("text", "lengths"), F.col("start"))).withColumn("n", C.learned(F.col("labels"))).collect()
    for r in got:
        assert r.text == r.whole and [r.text[s.start : s.end] for s in r.spans] == [x.content or "" for x in r.messages]
        if last != "assistant":
            assert r.start is None and r.n == 0 and set(r.labels) <= {C.IGNORED}
            continue
        assert r.text.startswith(r.asked) and r.start == len(r.asked)
        owner = [i for i, ch in enumerate(r.text) for _ in ch.encode()]
        at, want = 0, []
        for n, i in zip(r.lengths, r.ids):
            want.append(i if owner[at] >= r.start else C.IGNORED)
            at += n
        assert r.labels == want and r.n == sum(x != C.IGNORED for x in want)


def test_spans_stay_columns(spark, monkeypatch):
    """Spans of a batch of rows were a dict a token (some gigabytes for 10,000 documents) and left all at once."""
    monkeypatch.setattr(C, "TOKENS", 10)
    texts = ["abc", None, "", "öä" * 6, "x" * 25, "y"]
    lengths = [[1, 2], None, [], [1] * 24, [1] * 25, [1]]
    out = list(C.token_spans.func(iter([(pa.array(texts, pa.string()), pa.array(lengths, pa.list_(pa.int32())))])))
    assert all(isinstance(o, pa.ListArray) for o in out) and len(out) > 2
    got = [x for o in out for x in o.to_pylist()]
    assert got == [[{"start": 0, "end": 1}, {"start": 1, "end": 3}], [], [], [{"start": i // 2, "end": i // 2 + 1} for i in range(24)], [{"start": i, "end": i + 1} for i in range(25)], [{"start": 0, "end": 1}]]
