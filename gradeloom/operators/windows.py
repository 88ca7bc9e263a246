"""Which phrases stand in which texts: hashes of all windows of a text from running sums, in time linear in its length.

A word's two hashes, each times a power of an odd number by its place, are summed up once along a text; a window's hash is the difference of two sums, times the inverse power, so that
equal words have equal hashes wherever they stand. Windows of a phrase's first words are looked up among all phrases' openings; only where one is found are windows
as long as the phrases that begin so looked up, by 128 bits of hash. Phrases go to the texts in blocks of bounded size, texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .postings import mixed

#: Phrases that go to the texts at a time: some 50 MB.
BLOCK = 1_000_000
_KEYS, _BASES = ("0123456789abcdef", "fedcba9876543210"), (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


class Sums:
    """Running sums of a text's words (ASCII white space between them)."""

    def __init__(self, text: str | None) -> None:
        words = np.array((text or "").encode().split() or [b""], object)
        self.n = len(words) if words[0] else 0
        self.sums, self.back = [], []
        for key, base, inverse in zip(_KEYS, _BASES, _INVERSES, strict=True):
            steps = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n, b, np.uint64)]))
            with np.errstate(over="ignore"):
                hashed = pd.util.hash_array(words[: self.n], hash_key=key, categorize=False) * steps(base)[:-1]
                self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed)]))
                self.back.append(steps(inverse))

    def windows(self, at: np.ndarray, length: np.ndarray | int, which: int) -> np.ndarray:
        """Hashes of the windows of so many words at these places."""
        with np.errstate(over="ignore"):
            return mixed((self.sums[which][at + length] - self.sums[which][at]) * self.back[which][at] + np.asarray(length).astype(np.uint64))


@dataclass
class Phrases:
    """A block of phrases: for each anchor length the openings (ascending) with the lengths that go with each, and all phrases by their hashes."""

    anchors: list[tuple[int, np.ndarray, np.ndarray]]
    first: np.ndarray
    second: np.ndarray
    length: np.ndarray
    items: pa.Array

    @classmethod
    def of(cls, table: pa.Table) -> Phrases:
        n, length, opening, first, second = (table[c].to_numpy() for c in ("n", "len", "a", "h1", "h2"))
        opening, first, second = (x.view(np.uint64) for x in (opening, first, second))
        anchors = []
        for k in np.unique(n):
            pairs = np.unique(np.stack([opening[n == k], length[n == k].astype(np.uint64)], 1), axis=0)
            anchors.append((int(k), pairs[:, 0].copy(), pairs[:, 1].astype(np.int64)))
        order = np.lexsort((second, length, first))
        return cls(anchors, first[order], second[order], length[order], table["item"].combine_chunks().take(pa.array(order)))

    def found(self, text: str | None) -> np.ndarray:
        """Places in ``items`` of those that stand in a text."""
        sums, hits = Sums(text), []
        for n, openings, lengths in self.anchors:
            if sums.n < n:
                continue
            at = np.arange(sums.n - n + 1)
            seen = sums.windows(at, n, 0)
            low, high = np.searchsorted(openings, seen, "left"), np.searchsorted(openings, seen, "right")
            some = np.flatnonzero(high > low)
            if not len(some):
                continue
            many = high[some] - low[some]
            ends = np.cumsum(many)
            place = np.repeat(at[some], many)
            k = lengths[np.arange(ends[-1]) + np.repeat(low[some] - (ends - many), many)]
            fits = place + k <= sums.n
            place, k = place[fits], k[fits]
            a, b = sums.windows(place, k, 0), sums.windows(place, k, 1)
            windows = np.unique(np.stack([a, b, k.astype(np.uint64)], 1), axis=0)  # a phrase that stands there often is looked up once
            low, high = np.searchsorted(self.first, windows[:, 0], "left"), np.searchsorted(self.first, windows[:, 0], "right")
            for x, i, j in zip(windows, low, high, strict=True):
                if i < j:
                    hits.append(i + np.flatnonzero((self.second[i:j] == x[1]) & (self.length[i:j] == int(x[2]))))
        return np.unique(np.concatenate(hits)) if hits else np.empty(0, np.int64)


def hashed(items: DataFrame, key: str, text: str, anchor: int) -> DataFrame:
    """item, its words (len), its anchor length (n), the hash of its opening and its two hashes; items without words are left out."""
    kinds = T.StructType([T.StructField("item", items.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("len", "n", "a", "h1", "h2"))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, out = b.column(0), []
            for t in b.column(1).to_pylist():
                s = Sums(t)
                n = min(anchor, s.n)
                zero = np.zeros(1, np.int64)
                out.append([s.n, n, *(int(s.windows(zero, size, i)[0].view(np.int64)) for size, i in ((n, 0), (s.n, 0), (s.n, 1)))])
            columns = [own, *(pa.array([o[i] for o in out], pa.int64()) for i in range(5))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "len", "n", "a", "h1", "h2"]).filter(pa.array([o[0] > 0 for o in out], pa.bool_()))

    return items.select(key, text).mapInArrow(rows, kinds)


def standing(texts: DataFrame, key: str, text: str, phrases: DataFrame, item_key: str, block: int = BLOCK) -> DataFrame:
    """item_key and key of each of ``phrases`` (see ``hashed``; a written table) that stands in a text; a row of texts has a pair once."""
    context, count = texts.sparkSession.sparkContext, phrases.count()
    kinds = T.StructType([T.StructField(item_key, phrases.schema["item"].dataType), T.StructField(key, texts.schema[key].dataType)])
    parts, out = max(1, -(-count // block)), texts.select(F.lit(None).cast(kinds[0].dataType).alias(item_key), key).filter("false")
    for part in range(parts):
        mine = phrases.filter(F.pmod(F.xxhash64("h1", "h2"), F.lit(parts)) == part).toArrow()  # about ``block`` rows
        shipped = context.broadcast(mine)

        def rows(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            own = Phrases.of(shipped.value)
            for b in batches:
                found = [own.found(t) for t in b.column(1).to_pylist()]
                whose = np.repeat(np.arange(len(found)), [len(f) for f in found])
                item = own.items.take(pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([item, b.column(0).take(pa.array(whose))], [item_key, key])

        if mine.num_rows:
            out = out.unionAll(texts.select(key, text).mapInArrow(rows, kinds))
    return out
