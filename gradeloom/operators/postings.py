"""Top-k by TF-IDF cosine from an index of the queries, with dynamic pruning.

Queries, a block of them at a time, become posting lists by gram with each list's weights; candidates are read once, where they lie, and nothing but the best k of each
query leaves a task. A task knows each query's kth score so far. A posting's weight over that score says how much of the way to the top k its gram can be worth, and the
largest such share of a list, times the candidate's own weight, bounds what the gram can do for any query. A candidate's grams are taken by falling
bound until the rest together can't bring a query from nothing to its kth score: the lists of frequent grams, whose weights are small everywhere, are not read as soon as
scores have risen. Queries that were met, and that the rest could still bring there, are completed from their own vectors.
Candidates wait until there are ``ANEW``; grams that many queries hold then go by one product of matrices, the others by their lists. Where the bounds are far from the kth
scores, as among random texts, nothing is left out, and nothing is sorted either.

Documents share most words, so a task makes and looks up the grams of a word once (``Texts``), for document frequencies and for scores alike; a text's are put together
from its words' by place, without sorting.

What is left out can't be among the top k, so results are those of a full product. Candidates' norms need every gram's document frequency: these are counted
over all texts, by tasks first, and shipped to tasks if they are ``MOST_GRAMS`` at most (64 MB); the caller has another way beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Which code points are white space of Unicode.
_BLANK = np.zeros(0x110000, bool)
_BLANK[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
#: A step of hashes, and its inverse.
_STEP, _BACK = np.uint64(0xD1342543DE82EF95), np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))
#: Grams that tasks are sent at most, queries a block, grams of words that a task keeps, and letters whose texts are taken together.
MOST_GRAMS, BLOCK, HELD, LETTERS = 4_000_000, 2_000, 8_000_000, 500_000
#: Candidates after which bounds are made anew, queries up to which each is completed by itself and a list is short, the share of queries (one in ...) that hold a common gram, numbers that a matrix of those has at most, and what
#: a candidate's grams can be worth together, in kth scores, from which on leaving some out saves too little.
ANEW, FEW, OFTEN, CELLS, LOOSE = 64, 12, 16, 4_000_000, 4.0
SCORED = "query_id long, candidate_id long, similarity double, touched long"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: A random number of each code point; white space has that of a space.
with np.errstate(over="ignore"):
    _LETTER = mixed(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LETTER[_BLANK] = _LETTER[32]


class Places:
    """Numbers of 64-bit hashes: their places in ``known``, which is sorted; without it they are given as hashes come, and ``met`` holds the hashes by number.

    Even bins by a hash's first bits say where among the sorted ones to look, and a step or two does the rest."""

    def __init__(self, known: np.ndarray | None = None) -> None:
        self.number = np.empty(0, np.int32) if known is None else None
        self.met = np.empty(0, np.uint64) if known is None else known
        self._sort(self.met)

    def _sort(self, known: np.ndarray) -> None:
        bits = max(1, (2 * len(known)).bit_length())
        self.known, self.shift = np.append(known, np.uint64(2**64 - 1)), np.uint64(64 - bits)
        self.lead = np.append(0, np.cumsum(np.bincount((known >> self.shift).astype(np.int64), minlength=2**bits))).astype(np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        at = self.lead[(hashes >> self.shift).astype(np.int64)]
        low = np.flatnonzero(self.known[at] < hashes)
        while len(low):
            at[low] += 1
            low = low[self.known[at[low]] < hashes[low]]
        return at

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = self._find(hashes)
        if self.number is None:
            return at
        none = (at == len(self.met)) | (self.known[at] != hashes)
        if none.any():
            new = np.unique(hashes[none])
            between = np.searchsorted(self.known[:-1], new)
            self.number = np.insert(self.number, between, np.arange(len(self.met), len(self.met) + len(new), dtype=np.int32))
            self.met = np.concatenate([self.met, new])
            self._sort(np.insert(self.known[:-1], between, new))
            at = self._find(hashes)
        return self.number[at]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of texts as random numbers, white space as one space; where each word begins with the space before it, how many letters it has with both spaces, and at which word each text begins and the last ends."""
    lower = [(t or "").lower() for t in texts]
    code = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    blank = _BLANK[code]
    start = np.flatnonzero(blank[:-1] & ~blank[1:])
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 2
    first = np.cumsum([0, *(len(t) + 1 for t in lower)])
    return _LETTER[code], start, end - start, np.searchsorted(start, first)


def word_hashes(letter: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    with np.errstate(over="ignore"):
        steps = np.full(len(letter), _STEP)
        steps[0] = 1
        back = np.full(len(letter), _BACK)
        back[0] = 1
        total = np.append(np.uint64(0), np.cumsum(letter * np.multiply.accumulate(steps)))
        return (total[start + length] - total[start]) * np.multiply.accumulate(back)[start]


def word_grams(letter: np.ndarray, start: np.ndarray, length: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the character n-grams of words with a space at both ends, word by word, and how many each has; a word that is then shorter than the first size counts once, whole."""
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ends = np.cumsum(length)
    owner = np.repeat(np.arange(len(start)), length)
    left = ends[owner] - np.arange(ends[-1])  # letters from each on, to its word's end
    letter = letter[np.arange(ends[-1]) + np.repeat(start - (ends - length), length)]
    some, whose, h = [], [], np.zeros(len(letter) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, min(sizes[-1], len(letter)) + 1):
            h = h[:-1] * _STEP + letter[n - 1 :]
            there, mine = left[: len(h)], owner[: len(h)]
            take = there >= n if n in sizes else (there == n) & (length[mine] == n) & (n < sizes[0])
            some.append(h[take])
            whose.append(mine[take])
    mine = np.concatenate(whose)
    return np.concatenate(some)[np.argsort(mine, kind="stable")], np.bincount(mine, minlength=len(start))


def grams(text: str | None, sizes: tuple[int, ...]) -> np.ndarray:
    """64-bit hashes of the character n-grams of each word between single spaces, lower case; a padded word shorter than the first size counts once, whole."""
    return word_grams(*words([text])[:3], sizes)[0]


def _put(room: np.ndarray, n: int, new: np.ndarray) -> np.ndarray:
    """``room`` with ``new`` from place n on; it grows by doubling."""
    if n + len(new) > len(room):
        room = np.concatenate([room[:n], np.zeros(n + 2 * len(new), room.dtype)])
    room[n : n + len(new)] = new
    return room


def portions(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in order, of about ``LETTERS`` together or one by itself."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size > LETTERS:
            yield some
            some, size = [], 0
    if some:
        yield some


class Texts:
    """Texts as places and counts of their grams. A word's grams are made and looked up once, whatever texts it stands in; ``size`` of them are kept until ``clear``."""

    def __init__(self, sizes: tuple[int, ...], known: np.ndarray | None = None) -> None:
        self.sizes, self.places = sizes, Places(known)
        self.slot = np.zeros(len(self.places.met), np.int32)
        self.clear()

    def clear(self) -> None:
        self.numbers, self.made, self.size, self.start, self.flat = Places(), 0, 0, np.zeros(1, np.int64), np.empty(0, np.int32)

    def of(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of each text's grams, and how often each stands there."""
        letter, start, length, first = words(texts)
        number = self.numbers.of(word_hashes(letter, start, length))
        fresh = np.flatnonzero(number >= self.made)
        new = fresh[np.unique(number[fresh], return_index=True)[1]]  # one place of each new word, by number
        raw, n = word_grams(letter, start[new], length[new], self.sizes)
        self.start = _put(self.start, self.made + 1, self.size + np.cumsum(n))
        self.flat = _put(self.flat, self.size, self.places.of(raw))
        self.made, self.size = self.made + len(new), self.size + len(raw)
        if len(self.slot) < len(self.places.met):
            self.slot = np.zeros(2 * len(self.places.met), np.int32)
        for a, b in zip(first[:-1], first[1:]):
            own = number[a:b]
            begin = self.start[own]
            n = self.start[own + 1] - begin
            ends = np.cumsum(n)
            every = np.arange(ends[-1] if len(ends) else 0)
            place = self.flat[every + np.repeat(begin - (ends - n), n)].astype(np.int64)
            self.slot[place] = every  # one of equal ones stays
            who = self.slot[place]
            once = np.flatnonzero(who == every)
            yield place[once], np.bincount(who, minlength=len(every))[once]


def weights(place: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of a text's grams by place and count, scaled to length 1."""
    w = (1 + np.log(np.arange(1, tf.max(initial=0) + 1)))[tf - 1] * idf[place]
    return w / max(1e-300, float(np.sqrt(w @ w)))


def vectors(raw: np.ndarray, known: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``known`` of a text's grams, and their weights."""
    some, tf = np.unique(raw, return_counts=True)
    place = np.searchsorted(known, some)
    return place, weights(place, tf, idf)


def frequencies(texts: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """gram and df: in how many rows of ``texts`` (text) each gram stands; tasks add up what they see, until they keep ``HELD`` grams of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, df = Texts(sizes), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            met = seen.places.met
            return pa.RecordBatch.from_arrays([pa.array(met.view(np.int64)), pa.array(df[: len(met)])], ["gram", "df"])

        for b in batches:
            for some in portions(b.column(0).to_pylist()):
                for place, _ in seen.of(some):
                    if len(df) < len(seen.slot):
                        df = np.append(df, np.zeros(len(seen.slot) - len(df), np.int64))
                    df[place] += 1
                if seen.size > HELD:
                    yield out()
                    seen, df = Texts(sizes), np.zeros(0, np.int64)
        if seen.size:
            yield out()

    return texts.select("text").mapInArrow(count, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))


@dataclass
class QueryIndex:
    """Posting lists of a block of queries: for list i the places start[i] to start[i + 1] of ``who`` and ``weight``; ``place`` says which list a gram has (-1: none)."""

    ids: np.ndarray
    place: np.ndarray
    start: np.ndarray
    who: np.ndarray
    weight: np.ndarray
    own: list[tuple[np.ndarray, np.ndarray]]
    k: int
    digits: int

    @classmethod
    def of(cls, ids: list[int], found: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, digits: int) -> QueryIndex:
        gram = np.concatenate([g for g, _ in found]) if found else np.empty(0, np.int64)
        who = np.repeat(np.arange(len(found)), [len(g) for g, _ in found]) if found else gram
        weight = np.concatenate([w for _, w in found]) if found else np.empty(0)
        lists = np.unique(gram)
        at = np.searchsorted(lists, gram)
        order = np.lexsort((-weight, at))  # within a list by falling weight
        place = np.full(size, -1)
        place[lists] = np.arange(len(lists))
        own = [(place[g], w) for g, w in found]
        return cls(np.array(ids, np.int64), place, np.searchsorted(at[order], np.arange(len(lists) + 1)), who[order].astype(np.int64), weight[order], own, k, digits)

    def reset(self) -> None:
        n = len(self.ids)
        self.best, self.best_ids, self.touched, self.waiting = np.full((n, self.k), -1.0), np.zeros((n, self.k), np.int64), 0, []
        size = np.diff(self.start)
        common = np.flatnonzero((size * OFTEN >= n) & (size >= FEW))
        common = common[np.argsort(-size[common], kind="stable")][: CELLS // max(n, 1)]
        self.column, self.matrix = np.full(len(size), -1), np.zeros((len(common), n))
        self.column[common] = np.arange(len(common))
        lists = np.repeat(self.column, size)
        self.matrix[lists[lists >= 0], self.who[lists >= 0]] = self.weight[lists >= 0]
        self.bound()

    def bound(self) -> None:
        """What each list can be worth at most, as a share of the kth scores so far."""
        self.settle()
        self.least = np.maximum(self.best[:, -1] - 2 * 10.0**-self.digits, 0.0)  # scores are rounded, and equal ones count
        with np.errstate(divide="ignore"):
            share = np.where(self.least[self.who] > 0, self.weight / self.least[self.who], np.inf)
        self.most = np.maximum.reduceat(share, self.start[:-1]) if len(self.who) else np.empty(0)

    def postings(self, lists: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.start[lists]
        n = self.start[lists + 1] - first
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)
        return self.who[at], self.weight[at] * np.repeat(w, n)

    def add(self, candidate: int, places: np.ndarray, w: np.ndarray) -> None:
        """One candidate's vector, which waits for others until ``bound``."""
        lists = self.place[places]
        has = lists >= 0
        if has.any():
            self.waiting.append((candidate, lists[has], w[has]))

    def settle(self) -> None:
        """The candidates that wait, against all queries: common grams by a product of matrices, others by their lists."""
        if not self.waiting:
            return
        waiting, self.waiting = self.waiting, []
        score, common, tails = np.zeros((len(waiting), len(self.ids))), np.zeros((len(waiting), len(self.matrix))), []
        for row, (_, lists, w) in enumerate(waiting):
            bounds = w * self.most[lists]
            worth = float(bounds.sum())
            if worth < 1.0:
                continue
            column = self.column[lists]
            often = column >= 0
            seldom = ~often
            if worth < LOOSE:
                order = np.argsort(bounds)
                left = order[np.cumsum(bounds[order]) < 1.0]  # the grams that are worth least, and together too little
                read = np.ones(len(lists), bool)
                read[left] = False
                if (read & often).any():
                    read |= often
                else:
                    often = read & often
                seldom &= read
                if not read.all():
                    tails.append((row, lists[~read], w[~read], float(bounds[~read].sum())))
            at = column[often]
            if len(at):
                common[row, at] = w[often]
                self.touched += len(at) * len(self.ids)
            who, x = self.postings(lists[seldom], w[seldom])
            self.touched += len(who)
            score[row] = np.bincount(who, x, len(self.ids))
        score += common @ self.matrix
        for row, lists, w, rest in tails:
            own = score[row]
            near = (own > 0) & (own + rest * self.least >= self.least)
            self.complete(own, np.flatnonzero(near), lists, w)
            own[~near] = 0.0
        ids, s = np.array([c for c, _, _ in waiting], np.int64), np.round(score, self.digits)
        last, last_id = self.best[:, -1], self.best_ids[:, -1]
        for row, q in zip(*np.nonzero((score > 0) & ((s > last) | ((s == last) & (ids[:, None] < last_id)))), strict=True):
            candidate, x = ids[row], s[row, q]
            if x < self.best[q, -1]:  # others that waited are better
                continue
            other = (self.best_ids[q] != candidate) | (self.best[q] < 0)  # of rows with one id the best counts
            if x <= self.best[q][~other].max(initial=-1.0):
                continue
            scores, found = np.append(np.where(other, self.best[q], -1.0), x), np.append(self.best_ids[q], candidate)
            ranked = np.lexsort((found, -scores))[: self.k]
            self.best[q], self.best_ids[q] = scores[ranked], found[ranked]

    def complete(self, score: np.ndarray, met: np.ndarray, lists: np.ndarray, w: np.ndarray) -> None:
        """Adds to the scores of the queries ``met`` what the remaining grams give: from the queries' own vectors if they are few, else from the matrix and the lists."""
        if len(met) > FEW:
            column = self.column[lists]
            often = column >= 0
            who, x = self.postings(lists[~often], w[~often])
            self.touched += len(who) + int(often.sum()) * len(self.ids)
            score += w[often] @ self.matrix[column[often]] + np.bincount(who, x, len(self.ids))
            return
        order = np.argsort(lists)
        lists, w = lists[order], w[order]
        for q in met:
            own, own_w = self.own[q]
            at = np.minimum(np.searchsorted(own, lists), len(own) - 1)
            same = own[at] == lists
            score[q] += float(own_w[at[same]] @ w[same])
            self.touched += int(same.sum())


def nearest(queries: DataFrame, candidates: DataFrame, k: int, sizes: tuple[int, ...], digits: int, df: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """query_id, candidate_id, similarity of each task's best k candidates of each query, and how many postings the task touched. ``df``: at most ``MOST_GRAMS`` rows."""
    table = df.toArrow()
    gram = table["gram"].to_numpy().view(np.uint64)
    order = np.argsort(gram)
    context = candidates.sparkSession.sparkContext
    shipped = context.broadcast((gram[order], np.log((1.0 + total) / (1.0 + table["df"].to_numpy()[order])) + 1.0))
    n = queries.count()
    out = None
    for part in range(max(1, -(-n // block))):
        mine = queries.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // block)))) == part).select("id", "text").toArrow()  # a block of queries
        known, idf = shipped.value
        ids = mine["id"].to_pylist()
        index = context.broadcast(QueryIndex.of(ids, [vectors(grams(t, sizes), known, idf) for t in mine["text"].to_pylist()], len(known), k, digits))

        def score(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known, idf = shipped.value
            q = index.value
            q.reset()
            n, seen = 0, Texts(sizes, known)
            for b in batches:
                ids = iter(b.column(0).to_pylist())
                for some in portions(b.column(1).to_pylist()):
                    for place, tf in seen.of(some):
                        i = next(ids)
                        if len(place):
                            q.add(i, place, weights(place, tf, idf))
                            n += 1
                            if not n % ANEW:
                                q.bound()
                    if seen.size > HELD:
                        seen.clear()
            q.settle()
            row, at = np.nonzero(q.best >= 0)
            columns = [pa.array(q.ids[row]), pa.array(q.best_ids[row, at]), pa.array(q.best[row, at]), pa.array(np.full(len(row), q.touched))]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "candidate_id", "similarity", "touched"])

        some = candidates.select(F.col("id").cast("long"), "text").mapInArrow(score, SCORED)
        out = some if out is None else out.unionAll(some)
    return out
