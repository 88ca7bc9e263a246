"""Language-model scores from Brown class-based bigrams.

Every word that stands ``least`` times or more in the training texts has a class of its own choice; words below that, and words not seen, have the class of
a group. Exchange clustering first assigns the ``own`` most frequent words, each alone, the end of a text, and groups of the other words by a
hash of their last two bytes: they move, one at a time, to the class that most raises the likelihood of the training texts' class bigrams, until
a sweep moves none or ``sweeps`` have passed. Then each of the other words of ``least`` or more leaves its group for the class that most raises that
likelihood, from its own counts of the classes before and after it; all of these words choose at once, against the class bigrams of the first
step. The clustered vocabulary so grows with the training texts. The probability of a word after another is

    P(class | class before) * P(word | class)

with class transitions smoothed towards class frequencies and words by half counts; each class keeps half a count for words not seen.

Counts cover all training texts: one pass counts all words (combined in each task, then shuffled by a 64-bit hash of the word), one counts
bigrams of the first step's units, whose number is bounded by the units' square, one the neighbours' classes of the words that choose, packed by
buckets of words, and one the bigrams of the final classes. The ``head`` most frequent words, a fixed number, are looked up in place. Whether a word
beyond them is one that chooses is told by a filter of fixed size, which may say yes too often, never no: only those words' classes come by a
join on the hash, and their neighbours by the place in the text. Counts of all words beyond the head come by a join for the base score.

Two words with one 64-bit hash would count as one: with n distinct words the chance of any is about n*n / 2**65.

Defined cases: null and empty texts have one token, the end. Without training texts every count is 0 and scores equal base scores.
Repeated rows are scored, and counted, one by one; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BOOL, DOUBLE, INT, LONG, batch_of, crc_fold, durable, few_rows_a_batch, schema, small_batches, word_hashes, word_spans

OWN, GROUPS, CLASSES, SWEEPS, HEAD, KAPPA, LEAST = 1_000, 256, 64, 12, 1 << 19, 8.0, 3
#: Bits of the filter of words beyond the head that choose a class, and words that choose in one bucket.
BITS, BUCKET = 1 << 26, 20_000
#: Bytes of text hashed at a time.
SLICE = 1 << 20


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts, one after another: hash, group, and number of the text."""
    hashes, groups, numbers = [], [], []
    raws = [t.encode() for t in texts]
    i = 0
    while i < len(raws):
        j, size = i, 0
        while j < len(raws) and (j == i or size + len(raws[j]) < SLICE):
            size += len(raws[j]) + 1
            j += 1
        joined = b"\n".join(raws[i:j])
        lengths = np.array([len(r) for r in raws[i:j]], np.int64)
        firsts = np.cumsum(lengths + 1) - lengths - 1
        at = 0
        while at < len(joined):
            end = len(joined)
            if end - at > 2 * SLICE:  # a text longer than a slice is cut between words
                cut = max(joined.rfind(c, at, at + SLICE) for c in (b" ", b"\n", b"\t"))
                end = cut + 1 if cut > at else end
            piece = joined[at:end]
            raw = np.frombuffer(piece, np.uint8)
            starts, ends = word_spans(raw)
            hashes.append(word_hashes(piece))
            low = raw[ends - 1].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
            low = np.where((low >= 65) & (low <= 90), low + 32, low)
            before = np.where(ends - starts > 1, raw[np.maximum(ends - 2, 0)], 0).astype(np.int64) if len(ends) else low
            before = np.where((before >= 65) & (before <= 90), before + 32, before)
            groups.append(((low * 131 + before * 31 + (before >> 4)) % GROUPS).astype(np.int64))
            numbers.append(i + np.searchsorted(firsts, starts + at, "right") - 1)
            at = end
        i = j
    none = np.zeros(0, np.int64)
    return (np.concatenate(hashes).view(np.int64) if hashes else none, np.concatenate(groups) if groups else none, np.concatenate(numbers) if numbers else none)


@dataclass
class Units:
    """The words with a unit of their own (sorted hashes, and each one's unit); groups follow them, the end of a text is last."""

    words: np.ndarray
    unit: np.ndarray

    @property
    def count(self) -> int:
        return len(self.words) + GROUPS + 1

    @property
    def end(self) -> int:
        return self.count - 1

    def of(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return g
        i = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[i] == h, self.unit[i], len(self.words) + g)

    def sequence(self, u: np.ndarray, number: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Units with an end after each text's, and each token's text."""
        sizes = np.bincount(number, minlength=texts)
        out, which = np.full(len(u) + texts, self.end), np.repeat(np.arange(texts), sizes + 1)
        out[np.arange(len(u)) + number] = u
        return out, which


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each unit, from the counts of unit bigrams (dense, units x units), by exchange clustering."""
    n = len(pairs)
    k = max(1, min(classes, n))
    size = pairs.sum(1) + pairs.sum(0)
    order = np.argsort(-size, kind="stable")
    of = np.zeros(n, np.int64)
    of[order] = np.arange(n) % k
    hot = np.zeros((n, k))
    hot[np.arange(n), of] = 1
    right, left = pairs @ hot, pairs.T @ hot  # by unit: counts to and from each class
    big = hot.T @ right
    rows, cols = big.sum(1), big.sum(0)
    # What each row and column of the class matrix adds to the likelihood.
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not size[u]:
                continue
            a, own = of[u], pairs[u, u]
            r, c = right[u].copy(), left[u].copy()
            r[a] -= own
            c[a] -= own
            # Take the unit out of its class.
            big[a, :] -= r
            big[:, a] -= c
            big[a, a] -= own
            out_, in_ = r.sum() + own, c.sum() + own
            rows[a] -= out_
            cols[a] -= in_
            # The gain of each class: its row takes r, its column c, the diagonal both and the unit's own pairs.
            row_gain = (xlogx(big + r[None, :]) - xlogx(big)).sum(1)
            col_gain = (xlogx(big + c[:, None]) - xlogx(big)).sum(0)
            d = np.diag(big)
            diagonal = xlogx(d + r + c + own) - xlogx(d + r) - xlogx(d + c) + xlogx(d)
            gain = row_gain + col_gain + diagonal - (xlogx(rows + out_) - xlogx(rows)) - (xlogx(cols + in_) - xlogx(cols))
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            big[b, :] += r
            big[:, b] += c
            big[b, b] += own
            rows[b] += out_
            cols[b] += in_
            if b != a:
                of[u] = b
                moved += 1
                right[:, a] -= pairs[:, u]
                right[:, b] += pairs[:, u]
                left[:, a] -= pairs[u, :]
                left[:, b] += pairs[u, :]
        if not moved:
            break
    return of


def choices(found: np.ndarray, now: np.ndarray, big: np.ndarray) -> np.ndarray:
    """The best class of each word, from its counts of the classes before and after it (words x twice the classes), its class and the class bigrams.

    Each word is taken out of its class and put where the likelihood gains most, the other words staying where they are. Its own class wins ties.
    """
    k, i = len(big), np.arange(len(now))
    before, after = found[:, :k].astype(float), found[:, k:].astype(float)

    def change(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What n more adds to x log x; counts of a word beside itself are on both sides, so x can fall below 0."""
        x = np.maximum(x, 0)
        return xlogx(x + n) - xlogx(x)

    # By class: the cells that the word's pairs fall into if it is put there, without what the word has in them now.
    gain = np.zeros((len(now), k))
    word, slot = np.nonzero(found)
    cells = np.concatenate([big, big.T])
    for at in range(0, len(word), 1 << 14):
        w, s = word[at : at + (1 << 14)], slot[at : at + (1 << 14)]
        n, cell = found[w, s].astype(float), cells[s]
        cell[np.arange(len(w)), now[w]] -= n
        x, y = np.flatnonzero(s == now[w]), np.flatnonzero(s == now[w] + k)
        cell[x] -= after[w[x]]
        cell[y] -= before[w[y]]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[first]] += np.add.reduceat(change(cell, n[:, None]), first)
    # The diagonal cell takes both sides at once.
    w, b = np.nonzero((before > 0) & (after > 0))
    x, y = before[w, b], after[w, b]
    d = np.diag(big)[b] - np.where(b == now[w], x + y, 0.0)
    gain[w, b] += change(d, x + y) - change(d, x) - change(d, y)
    for total, n in ((big.sum(1), after.sum(1)), (big.sum(0), before.sum(1))):
        rest = np.repeat(total[None, :], len(now), 0)
        rest[i, now] -= n
        gain -= change(rest, n[:, None])
    best = gain.argmax(1)
    return np.where(gain[i, best] > gain[i, now] + 1e-9, best, now)


@dataclass
class Filter:
    """A Bloom filter with two probes over 64-bit hashes; None: empty."""

    bits: np.ndarray | None = None

    def has(self, h: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.zeros(len(h), bool)
        out = np.ones(len(h), bool)
        for p in probes(h, 64 * len(self.bits)):
            out &= (self.bits[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


def probes(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a filter of a size (a power of two)."""
    return h & (size - 1), (h >> 32) & (size - 1)


def filter_of(words: DataFrame) -> Filter:
    """A filter of the words (w); its longs, ``BITS`` / 64 at most, come to the driver."""
    bit = [F.col("w").bitwiseAND(F.lit(BITS - 1)), F.shiftright("w", 32).bitwiseAND(F.lit(BITS - 1))]
    at = words.select(F.explode(F.array(*bit)).alias("p"))
    got = at.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("x")).toArrow()
    if not got.num_rows:
        return Filter()
    bits = np.zeros(BITS >> 6, np.int64)
    bits[got["i"].to_numpy()] = got["x"].to_numpy()
    return Filter(bits.view(np.uint64))


@dataclass
class Lookup:
    """Classes of the most frequent words (sorted hashes) and of the groups, and the filter of other words that have a class of their own choice."""

    words: np.ndarray
    class_of: np.ndarray
    group: np.ndarray
    end: int
    others: Filter

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place among the most frequent ones, and whether it is one."""
        if not len(self.words):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        i = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return i, self.words[i] == h

    def sequence(self, h: np.ndarray, g: np.ndarray, number: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes with an end after each text's (-1: comes by a join), each token's text, and the words' places."""
        i, is_head = self.of(h)
        cls = np.where(is_head, self.class_of[i], -1) if len(self.words) else np.full(len(h), -1)
        rest = np.flatnonzero(~is_head)
        cls[rest] = np.where(self.others.has(h[rest]), -1, self.group[g[rest]])
        sizes = np.bincount(number, minlength=texts)
        out, which = np.full(len(h) + texts, self.end), np.repeat(np.arange(texts), sizes + 1)
        at = np.arange(len(h)) + number
        out[at] = cls
        return out, which, at

    def far(self, h: np.ndarray, g: np.ndarray, cls: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the words whose classes are joined: which they are, places, hashes, classes before and after (-1: such a word too), and groups' classes."""
        where = np.flatnonzero(cls[at] < 0)
        place = at[where]
        return where, place, h[where], np.where(place > 0, cls[place - 1], self.end), cls[place + 1], self.group[g[where]]


def joined(far: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows __row, __at, __w, __before, __after, __group with __class, in order of text and place, so that neighbours follow each other."""
    with_class = far.join(classes.select(F.col("w").alias("__w"), "k"), "__w", "left").select("__row", "__at", "__before", "__after", F.coalesce("k", "__group").alias("__class"))
    return with_class.repartition("__row").sortWithinPartitions("__row", "__at")


class Chain:
    """Class before each row of a partition of ``joined``, batch after batch."""

    def __init__(self) -> None:
        self.last = -1

    def before(self, b: pa.RecordBatch) -> np.ndarray:
        given, cls = b.column("__before").to_numpy(), b.column("__class").to_numpy()
        out = np.where(given < 0, np.concatenate([[self.last], cls[:-1]]), given)
        self.last = cls[-1] if len(cls) else self.last
        return out


@dataclass
class Model:
    lookup: Lookup
    transition: np.ndarray  # log10, classes x classes
    spread: np.ndarray  # log10 (words of a class + half counts), by class
    head_log: np.ndarray  # log10 (count + 0.5)
    end_log: float
    base: float  # log10 (N + 0.5 (V + 1))
    total: int


@dataclass
class Words:
    """Counts (w, g, c) of all words of the training texts, and classes (w, k) of those that chose one."""

    counts: DataFrame
    classes: DataFrame


FAR = schema(__row=LONG, __at=LONG, __w=LONG, __before=INT, __after=INT, __group=INT)
PAIRS = schema(p=LONG, n=LONG)


def train(docs: DataFrame, keep, own: int = OWN, classes: int = CLASSES, sweeps: int = SWEEPS, head: int = HEAD, least: int = LEAST) -> tuple[Model, Words]:
    """A model of documents (doc_id, text) where ``keep`` holds, and their words."""
    few_rows_a_batch(docs.sparkSession)
    texts = docs.filter(keep).select(F.coalesce("text", F.lit("")).alias("text"))
    kinds = schema(w=LONG, g=INT, c=LONG)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            h, first, n = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_counts=True)
            return batch_of(kinds, {"w": pa.array(h), "g": pa.array(np.concatenate([p[1] for p in parts])[first].astype(np.int32)), "c": pa.array(n)})

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for b in small_batches(batches, 4 << 20):
            parts.append(tokens_of(b.column(0).to_pylist())[:2])
            if sum(len(p[0]) for p in parts) > 4_000_000:
                yield combined(parts)
                parts = []
        if parts:
            yield combined(parts)

    counts = durable(texts.mapInArrow(count, kinds).groupBy("w").agg(F.min("g").alias("g"), F.sum("c").alias("c")))
    ends = texts.count()
    words, kinds_seen, choosing = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") >= least)).first()
    total, seen = words + ends, kinds_seen + (ends > 0)
    top = counts.orderBy(F.desc("c"), "w").limit(max(head, own)).toArrow()
    top_w, top_g, top_c = (top[x].to_numpy().astype(np.int64) for x in ("w", "g", "c"))
    lone = min(own, len(top_w))
    by_hash = np.argsort(top_w[:lone], kind="stable")
    units = Units(top_w[:lone][by_hash], by_hash.astype(np.int64))
    beyond = (F.col("c") < int(top_c[-1])) | ((F.col("c") == int(top_c[-1])) & (F.col("w") > int(top_w[-1]))) if len(top_w) else F.lit(True)
    others = filter_of(counts.filter(beyond & (F.col("c") >= least)))
    side = units.count

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(side * side, np.int64)
        for b in small_batches(batches, 4 << 20):
            h, g, number = tokens_of(b.column(0).to_pylist())
            u, _ = units.sequence(units.of(h, g), number, b.num_rows)
            at, n = np.unique(np.concatenate([[units.end], u[:-1]]) * side + u, return_counts=True)
            found[at] += n
        at = np.flatnonzero(found)
        yield batch_of(PAIRS, {"p": pa.array(at), "n": pa.array(found[at])})

    got = texts.mapInArrow(bigrams, PAIRS).groupBy("p").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(side * side)
    pairs[got["p"].to_numpy()] = got["n"].to_numpy()
    pairs = pairs.reshape(side, side)
    of = exchange(pairs, classes, sweeps)
    k = int(of.max()) + 1
    hot = np.zeros((side, k))
    hot[np.arange(side), of] = 1
    first = hot.T @ pairs @ hot
    group = of[lone : lone + GROUPS]

    # The words that choose: those of the head that stand often enough, and what the filter lets through.
    some = np.sort(top_w[lone:][top_c[lone:] >= least])
    buckets = max(64, -(-choosing // BUCKET))
    packed = T.StructType([T.StructField("bucket", INT), T.StructField("w", T.BinaryType()), T.StructField("x", T.BinaryType())])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of each word and neighbouring class (before: 0 to k - 1, after: k to 2 k - 1) its hash, and slot, group and count in one long.
        def combined(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            h, g, before, after = (np.concatenate(x) for x in zip(*parts, strict=True))
            w, at, of_word = np.unique(h, return_index=True, return_inverse=True)
            key, n = np.unique(np.concatenate([of_word * 2 * k + before, of_word * 2 * k + k + after]), return_counts=True)
            word = key // (2 * k)
            bucket = (w[word].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            hashes, x = w[word][order], (key % (2 * k) + (g[at][word] << 16) + (n << 32))[order]
            there = np.flatnonzero(np.diff(cut))
            return batch_of(packed, {"bucket": pa.array(there.astype(np.int32)), "w": [hashes[cut[i] : cut[i + 1]].tobytes() for i in there], "x": [x[cut[i] : cut[i + 1]].tobytes() for i in there]})

        parts: list[tuple[np.ndarray, ...]] = []
        for b in small_batches(batches, 4 << 20):
            h, g, number = tokens_of(b.column(0).to_pylist())
            u, _ = units.sequence(units.of(h, g), number, b.num_rows)
            cls, at = of[u], np.arange(len(h)) + number
            far = np.flatnonzero(u[at] >= lone)
            in_head = some[np.minimum(np.searchsorted(some, h[far]), len(some) - 1)] == h[far] if len(some) else np.zeros(len(far), bool)
            far = far[in_head | others.has(h[far])]
            at = at[far]
            parts.append((h[far], g[far], np.where(at > 0, cls[at - 1], of[units.end]), cls[at + 1]))
            if sum(len(p[0]) for p in parts) > 2_000_000:
                yield combined(parts)
                parts = []
        if parts and sum(len(p[0]) for p in parts):
            yield combined(parts)

    class_kinds = schema(w=LONG, k=INT, c=LONG)

    def choose(bucket: pa.Table) -> pa.Table:
        h, x = (np.frombuffer(b"".join(bucket[c].to_pylist()), np.int64) for c in ("w", "x"))
        w, at, of_word = np.unique(h, return_index=True, return_inverse=True)
        out = []
        for i in range(0, len(w), BUCKET):  # a filter that lets too much through makes larger buckets
            mine = (of_word >= i) & (of_word < i + BUCKET)
            found = np.zeros((len(w[i : i + BUCKET]), 2 * k), np.int64)
            np.add.at(found, (of_word[mine] - i, x[mine] & 0xFFFF), x[mine] >> 32)
            now = group[(x[at[i : i + BUCKET]] >> 16) & 0xFFFF]
            times = found[:, :k].sum(1)
            keeps = times >= least  # what only the filter let through stays in its group
            out.append(batch_of(class_kinds, {"w": pa.array(w[i : i + BUCKET][keeps]), "k": pa.array(choices(found, now, first)[keeps]), "c": pa.array(times[keeps])}))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([batch_of(class_kinds, {"w": [], "k": [], "c": []})])

    moved = durable(texts.mapInArrow(neighbours, packed).groupBy("bucket").applyInArrow(choose, class_kinds))
    # Classes of the head: its own, those chosen, the groups'. Those beyond stay a table.
    top_k = np.concatenate([of[:lone], group[top_g[lone:]]]).astype(np.int64)
    chosen = moved.filter(~beyond).select("w", "k").toArrow()  # words of the head
    by_word = np.argsort(top_w, kind="stable")
    if chosen.num_rows:
        top_k[by_word[np.searchsorted(top_w[by_word], chosen["w"].to_numpy())]] = chosen["k"].to_numpy()
    rest = moved.filter(beyond).select("w", "k", "c")
    in_class = np.zeros((k, 2))
    np.add.at(in_class, top_k, np.stack([top_c, np.ones(len(top_c))], 1))
    in_class[of[units.end]] += (ends, ends > 0)
    for g, c, n in counts.filter(beyond).groupBy("g").agg(F.sum("c"), F.count("*")).collect():
        in_class[group[g]] += (c, n)
    if others.bits is not None:  # those that left their groups
        for a, b, c, n in rest.drop("c").join(counts, "w").groupBy("g", "k").agg(F.sum("c"), F.count("*")).collect():
            in_class[group[a]] -= (c, n)
            in_class[b] += (c, n)
    lookup = Lookup(top_w[by_word], top_k[by_word], group, int(of[units.end]), others)
    classes_ = rest.select("w", "k")

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = np.zeros(k * k, np.int64)
        for b in small_batches(batches, 4 << 20):
            h, g, number = tokens_of(b.column(0).to_pylist())
            cls, _, _ = lookup.sequence(h, g, number, b.num_rows)
            before = np.concatenate([[lookup.end], cls[:-1]])
            both = (before >= 0) & (cls >= 0)
            big += np.bincount(before[both] * k + cls[both], minlength=k * k)
        yield batch_of(PAIRS, {"p": pa.array(np.arange(k * k)), "n": pa.array(big)})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 4 << 20):
            h, g, number = tokens_of(b.column("text").to_pylist())
            cls, _, at = lookup.sequence(h, g, number, b.num_rows)
            where, place, w, before, after, own_group = lookup.far(h, g, cls, at)
            yield batch_of(FAR, {"__row": pa.array(b.column("__row").to_numpy()[number[where]]), "__at": pa.array(place), "__w": pa.array(w), "__before": pa.array(before), "__after": pa.array(after), "__group": pa.array(own_group)})

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big, chain = np.zeros(k * k, np.int64), Chain()
        for b in batches:
            cls, after = b.column("__class").to_numpy(), b.column("__after").to_numpy()
            last = after >= 0
            big += np.bincount(chain.before(b) * k + cls, minlength=k * k) + np.bincount(cls[last] * k + after[last], minlength=k * k)
        yield batch_of(PAIRS, {"p": pa.array(np.arange(k * k)), "n": pa.array(big)})

    sums = texts.mapInArrow(known, PAIRS)
    if others.bits is not None:
        # Rows are numbered for this one scan, to bring a text's words together.
        far = texts.withColumn("__row", F.monotonically_increasing_id()).mapInArrow(find, FAR)
        sums = sums.unionAll(joined(far, classes_).mapInArrow(linked, PAIRS))
    sums = sums.groupBy("p").agg(F.sum("n").alias("n")).toArrow()
    big = np.zeros(k * k)
    big[sums["p"].to_numpy()] = sums["n"].to_numpy()
    big = big.reshape(k, k)
    share = (in_class[:, 0] + 0.5) / (in_class[:, 0].sum() + 0.5 * k)
    transition = np.log10((big + KAPPA * share[None, :]) / (big.sum(1, keepdims=True) + KAPPA))
    spread = np.log10(in_class[:, 0] + 0.5 * (in_class[:, 1] + 1))
    model = Model(lookup, transition, spread, np.log10(top_c[by_word] + 0.5), float(np.log10(ends + 0.5)), float(np.log10(total + 0.5 * (seen + 1))), int(total))
    return model, Words(counts, moved.select("w", "k"))


def score(docs: DataFrame, model: Model, words: Words, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``carry`` with n_tokens, n_known, train_tokens, base_score and score of every document (text).

    One scan writes each text's sums over its words in place, with the hashes of the others; these find their counts, and some their classes, by joins.
    """
    rows = docs.select(*carry, F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("__row"))
    lookup = model.lookup
    far_type = T.ArrayType(T.StructType([f for f in FAR.fields if f.name != "__row"]), False)
    part_kinds = rows.drop("text").schema.add("n_tokens", LONG).add("__known", LONG).add("__base", DOUBLE).add("__score", DOUBLE).add("__tail", T.ArrayType(LONG)).add("__far", far_type)

    def lists(values: np.ndarray | pa.Array, owner: np.ndarray, d: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(d + 1)).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 4 << 20):
            h, g, number = tokens_of(b.column("text").to_pylist())
            d = b.num_rows
            i, is_head = lookup.of(h)
            logs = np.where(is_head, model.head_log[i] if len(lookup.words) else 0.0, 0.0)
            cls, which, at = lookup.sequence(h, g, number, d)
            before = np.concatenate([[lookup.end], cls[:-1]])
            path = np.where((before >= 0) & (cls >= 0), model.transition[before, cls], 0.0) - np.where(cls >= 0, model.spread[cls], 0.0)
            add = lambda w, n: np.bincount(n, w, d)
            where, *far = lookup.far(h, g, cls, at)
            inner = pa.StructArray.from_arrays([pa.array(x.astype(np.int64 if f.dataType == LONG else np.int32)) for x, f in zip(far, far_type.elementType.fields, strict=True)], [f.name for f in far_type.elementType.fields])
            made = {"n_tokens": np.bincount(number, minlength=d) + 1, "__known": np.bincount(number[is_head], minlength=d) + (model.total > 0), "__base": add(logs, number) + model.end_log, "__score": add(path, which)}
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*carry, "__row")), *(pa.array(v) for v in made.values()), lists(h[~is_head], number[~is_head], d), lists(inner, number[where], d)], part_kinds.names)

    each = durable(rows.mapInArrow(parts, part_kinds))
    tail = each.select("__row", F.explode("__tail").alias("w")).groupBy("__row", "w").agg(F.count("*").alias("n")).join(words.counts.select("w", "c"), "w", "left")
    c = F.coalesce("c", F.lit(0))
    tails = tail.groupBy("__row").agg(F.sum(F.col("n") * F.log10(c + F.lit(0.5))).alias("__log"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("__more"))
    whole = each.drop("__tail", "__far").join(tails, "__row", "left")
    path = F.lit(0.0)
    if lookup.others.bits is not None:
        far_kinds = schema(__row=LONG, __path=DOUBLE)

        def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chain = Chain()
            for b in batches:
                cls, after = b.column("__class").to_numpy(), b.column("__after").to_numpy()
                steps = model.transition[chain.before(b), cls] - model.spread[cls] + np.where(after >= 0, model.transition[cls, after], 0.0)
                row, at = np.unique(b.column("__row").to_numpy(), return_inverse=True)
                yield batch_of(far_kinds, {"__row": pa.array(row), "__path": pa.array(np.bincount(at, steps, len(row)))})

        far = each.select("__row", F.explode("__far").alias("f")).select("__row", "f.*")
        steps = joined(far, words.classes).mapInArrow(paths, far_kinds).groupBy("__row").agg(F.sum("__path").alias("__path"))
        whole, path = whole.join(steps, "__row", "left"), F.coalesce("__path", F.lit(0.0))
    log = F.coalesce("__log", F.lit(0.0))
    base = F.col("__base") + log - F.col("n_tokens") * model.base
    # The end's own log is in __base.
    score_ = F.col("__score") + path + F.col("__base") + log if model.total else base
    return whole.select(*carry, "n_tokens", (F.col("__known") + F.coalesce("__more", F.lit(0))).cast(LONG).alias("n_known"), F.lit(model.total).cast(LONG).alias("train_tokens"), base.alias("base_score"), score_.alias("score"))


#: Learning leaves this fold of 5 out.
HELD_OUT = (5, 1)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = crc_fold("doc_id", HELD_OUT[0]) == HELD_OUT[1]
    model, counts = train(docs, ~held)
    return score(docs.withColumn("held_out", held.cast(BOOL)), model, counts, ("doc_id", "held_out"))
