"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes, calibration.

Terms are words (runs of letters, lower-cased), their first five letters, and, for a term that stands 2 or 4 times in a text, a term
that says so (a cosine alone can't tell one mention from many). Every term of the labelled sample is in the vocabulary; none is cut. A term weighs
idf times its correlation with the label in the sample (the square root of chi-squared over the number of examples), so that words which say nothing
of toxicity count little, though not nothing. A text's vector is (1 + log count) times that weight over its whole text, scaled to length 1.

The index has a posting list a term. Lists of rare terms are short and are added up whole. Lists of frequent terms (in over an eighth of the examples) are
cut into blocks of examples with the largest weight of each block: a block's bound is what its frequent terms can add at most plus the best sum
of rare terms in it. Blocks are visited by falling bound, their examples scored exactly, and a query leaves when no block can reach its kth cosine:
the neighbours are those of a full scan. Queries go through the blocks together, in batches.

Votes weigh 1 / (0.05 + distance) squared, distance being 1 - cosine; a logistic curve fitted on leave-one-out votes of the examples makes them
probabilities. Texts with no neighbour get the share of toxic examples; that share also votes, with a fixed weight, so that a few distant neighbours
decide nothing. The neighbours' ids are the evidence.

Learning takes a bounded sample of labelled rows: ``sample``, a parameter, those with the smallest hashes of their id; of each label an eighth of it at
least, as far as there are such rows, so that a rare label isn't missed; the curve and the share weigh labels as often as they really are. The model's
size is bounded by the sample's texts; scoring is one pass over the texts where they lie.

Defined cases: null and empty texts have no neighbour. A label that is null doesn't count; of repeated labels of an id the largest counts;
of repeated documents with one id the sample takes the smallest text. Without labelled rows every score is 0.0. Equal cosines: the smaller id is nearer.
Terms are 64-bit hashes; that any two of a million share one has a chance near 1e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BOOL, DOUBLE, INT, LONG, batch_of, crc_fold, durable, few_rows_a_batch, mix64, place_numbers, schema, small_batches, texts

SAMPLE, NEIGHBOURS, BLOCK, BATCH = 1_200, 15, 64, 64
#: The least share of a label in the sample, and the share of examples over which a term is frequent.
LEAST_SHARE, FREQUENT = 0.125, 0.125
#: A full neighbourhood at this cosine counts as much as what is known of texts without any neighbour.
FAR = 0.3
#: A term that stands so often in a text counts as another term as well.
OFTEN = (2, 4)
#: Letters of a word's beginning that are a term too.
STEM = 5
#: Texts that a worker remembers.
KEEP_TEXTS = 20_000
_letter = np.zeros(0, bool)


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letter
    if not len(_letter):
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter


def terms_in(text: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of a text's words and of the beginnings of longer ones, ascending, and their counts; all words of the text at once."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[code]
    edge = np.diff(is_letter.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    code = code[starts[0] : ends[-1]]
    place = np.arange(starts[0], ends[-1]) - np.repeat(starts, np.diff(np.append(starts, ends[-1])))
    with np.errstate(over="ignore"):
        x = mix64(code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * place_numbers(int(place.max()) + 1)[place]
        x[~is_letter[starts[0] : ends[-1]]] = 0
        words = mix64(np.add.reduceat(x, starts - starts[0]) ^ (ends - starts).astype(np.uint64))
        long = ends - starts >= STEM
        begin = x[(starts[long] - starts[0])[:, None] + np.arange(STEM)].sum(1, dtype=np.uint64)
        stems = mix64(begin ^ np.uint64(0xBF58476D1CE4E5B9))
    return np.unique(np.concatenate([words, stems]), return_counts=True)


def mark(terms: np.ndarray, times: int) -> np.ndarray:
    """Hashes of the terms' marks."""
    with np.errstate(over="ignore"):
        return mix64(terms * np.uint64(0xD6E8FEB86659FD93) + np.uint64(times))


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's terms and their counts; the marks of frequent terms count 1."""
    terms, n = terms_in(text)
    marks = [mark(terms[n >= m], m) for m in OFTEN]
    return np.concatenate([terms, *marks]), np.concatenate([n, *(np.ones(len(x), np.int64) for x in marks)])


Vector = tuple[np.ndarray, np.ndarray]


@dataclass
class Index:
    """Terms (hashes, ascending) with their weights, and examples (ids, labels) with their postings by term."""

    vocabulary: np.ndarray
    weight: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    who: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    posted: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    k: int = NEIGHBOURS
    block: int = BLOCK
    curve: tuple[float, float] = (1.0, 0.0)
    alone: float = 0.0

    def build(self, ids: np.ndarray, labels: np.ndarray, vectors: list[Vector]) -> list[int]:
        """Takes the examples that have a vector; returns their places in the input."""
        # Examples that share their strongest term stand together, so block maxima are tight.
        kept = sorted((i for i, (t, _) in enumerate(vectors) if len(t)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), int(ids[i])))
        self.ids, self.labels = ids[kept].astype(np.int64), labels[kept].astype(float)
        term = np.concatenate([vectors[i][0] for i in kept]) if kept else np.zeros(0, np.int64)
        who = np.repeat(np.arange(len(kept), dtype=np.int32), [len(vectors[i][0]) for i in kept]) if kept else np.zeros(0, np.int32)
        order = np.argsort(term, kind="stable")
        self.who, self.posted = who[order], (np.concatenate([vectors[i][1] for i in kept])[order] if kept else np.zeros(0)).astype(np.float32)
        self.start = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        return kept

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def prepared(self) -> None:
        """Blocks of the frequent terms' lists with their maxima; made once a process."""
        if "_blocks" in self.__dict__:
            return
        df = self._df = np.diff(self.start)
        frequent = np.flatnonzero(df > FREQUENT * max(1, len(self.ids)))
        self._column = np.full(len(self.vocabulary), -1)
        self._column[frequent] = np.arange(len(frequent))
        n = max(1, -(-len(self.ids) // self.block))
        whole = np.zeros((len(frequent), n * self.block))
        for j, t in enumerate(frequent):
            whole[j, self.who[self.start[t] : self.start[t + 1]]] = self.posted[self.start[t] : self.start[t + 1]]
        cut = whole.reshape(len(frequent), n, self.block)
        self._blocks, self._maxima = np.ascontiguousarray(cut.transpose(1, 0, 2)), cut.max(2)
        self._ids = np.concatenate([self.ids, np.full(n * self.block - len(self.ids), np.iinfo(np.int64).max)])
        self._known: dict[bytes, tuple[float, list[int]]] = {}
        # Of each term the places of its marks; -1: it has none here.
        self._marks = []
        for m in OFTEN:
            hashes = mark(self.vocabulary, m)
            at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(0, len(self.vocabulary) - 1))
            self._marks.append(np.where(self.vocabulary[at] == hashes, at, -1) if len(self.vocabulary) else at)

    def vector(self, text: str) -> Vector:
        """Places of a text's terms in the vocabulary, and their weights, scaled."""
        self.prepared()
        terms, n = terms_in(text)
        if not len(terms) or not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0)
        place = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        there = self.vocabulary[place] == terms
        place, n = place[there], n[there]
        often = np.concatenate([m[place[n >= least]] for least, m in zip(OFTEN, self._marks, strict=True)])
        often = often[often >= 0]
        return self.scaled(np.concatenate([place, often]), np.concatenate([n, np.ones(len(often), np.int64)]))

    def scaled(self, places: np.ndarray, counts: np.ndarray) -> Vector:
        some = self.weight[places] > 0
        places = places[some]
        v = (1 + np.log(counts[some])) * self.weight[places]
        # Weights go into the index with 24 bits; texts have the same, so a text and its copy have a cosine of 1.
        return places, (v / max(1e-300, float(np.sqrt(v @ v)))).astype(np.float32).astype(float)

    def nearest(self, vectors: list[Vector], without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each vector, cosine and place of its k nearest examples with a cosine over 0. ``without``: a place that each leaves out."""
        self.prepared()
        if not len(self.ids):
            return [[] for _ in vectors]
        m, n, size = len(vectors), len(self._blocks), self.block
        rare, asked = np.zeros((m, n * size)), np.zeros((m, len(self._maxima)))
        for i, (t, v) in enumerate(vectors):
            column = self._column[t]
            asked[i, column[column >= 0]] = v[column >= 0]
            some, own = t[column < 0], v[column < 0]
            first, length = self.start[some], self._df[some]
            ends = np.cumsum(length)
            if len(ends):
                at = np.arange(ends[-1]) + np.repeat(first - (ends - length), length)
                rare[i] = np.bincount(self.who[at], self.posted[at] * np.repeat(own, length), n * size)
        if without is not None:
            skip = np.array(without)
            rare[np.flatnonzero(skip >= 0), skip[skip >= 0]] = -np.inf
        bounds = asked @ self._maxima + rare.reshape(m, n, size).max(2)
        best, who = np.zeros((m, self.k)), np.full((m, self.k), n * size)
        ids = np.append(self._ids, np.iinfo(np.int64).max)
        order, at, step = np.argsort(-bounds.max(0), kind="stable"), 0, 4
        while at < n:
            # The next blocks in falling order of the batch's bound; the first few give kth cosines, then more go at once.
            part = order[at : at + step]
            at, step = at + step, 2 * step
            open_ = (bounds[:, part] > 0) & (bounds[:, part] >= best[:, -1:] - 1e-9)
            part, active = part[open_.any(0)], np.flatnonzero(open_.any(1))
            if not len(active):
                continue
            places = (part[:, None] * size + np.arange(size)).ravel()
            found = np.concatenate([asked[active] @ self._blocks[b] for b in part], 1) + rare[np.ix_(active, places)]
            found = np.round(np.where(found > 0, found, 0.0), 9)
            # Cosines below the kth among those at hand can't be needed; equal ones can, for a smaller id.
            least = np.maximum(best[active, -1], np.partition(found, -self.k, 1)[:, -self.k] if found.shape[1] > self.k else 0.0)
            row, column = np.nonzero((found >= least[:, None]) & (found > 0))
            rows = np.concatenate([np.repeat(np.arange(len(active)), self.k), row])
            scores = np.concatenate([best[active].ravel(), found[row, column]])
            places = np.concatenate([who[active].ravel(), places[column]])
            ranked = np.lexsort((ids[places], -scores, rows))
            starts = np.searchsorted(rows[ranked], np.arange(len(active)))
            first = ranked[starts[:, None] + np.arange(self.k)]
            best[active], who[active] = scores[first], places[first]
        return [[(float(c), int(i)) for c, i in zip(best[j], who[j], strict=True) if c > 0] for j in range(m)]

    def vote(self, near: list[tuple[float, int]]) -> float | None:
        if not near:
            return None
        w = np.array([(0.05 + 1 - c) ** -2 for c, _ in near])
        rest = self.k * (0.05 + 1 - FAR) ** -2
        return float((w @ self.labels[[i for _, i in near]] + rest * self.alone) / (w.sum() + rest))

    def scores(self, texts_: list[str]) -> list[tuple[float, list[int]]]:
        """Probability and the neighbours' ids of each text."""
        self.prepared()
        keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts_]
        if len(self._known) > KEEP_TEXTS:
            self._known.clear()
        new = list({k: t for k, t in zip(keys, texts_, strict=True) if k not in self._known}.items())
        for i in range(0, len(new), BATCH):
            part = new[i : i + BATCH]
            for (key, _), near in zip(part, self.nearest([self.vector(t) for _, t in part]), strict=True):
                vote = self.vote(near)
                self._known[key] = (self.alone if vote is None else calibrated(vote, self.curve), [int(self.ids[i]) for _, i in near])
        return [self._known[k] for k in keys]

    def score(self, text: str) -> tuple[float, list[int]]:
        return self.scores([text])[0]


def calibrated(vote: float, curve: tuple[float, float]) -> float:
    return float(1 / (1 + np.exp(-(curve[0] * (vote - 0.5) + curve[1]))))


def fitted_curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Logistic regression of labels on votes, lightly held to a slope of 8, by Newton steps."""
    w, hold = np.array([8.0, 0.0]), np.array([0.02, 0.02])
    x = np.stack([votes - 0.5, np.ones(len(votes))], 1)
    often = np.ones(len(votes)) if weights is None else weights
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (often * p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (often * (p - labels)) + hold * (w - [8.0, 0.0]))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return (float(max(w[0], 0.0)), float(w[1]))


def weights_of(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """idf times the correlation with the label, of terms in so many toxic and clean examples."""
    n, df = n1 + n0, toxic + clean
    phi = np.abs(toxic * n0 - clean * n1) / np.sqrt(np.maximum(df * (n - df) * max(1, n1) * max(1, n0), 1e-12))
    return np.round(np.log(n / df) * (np.minimum(1.0, phi) if n1 and n0 else 1.0), 12)


def learned(index: Index, ids: np.ndarray, toxic: np.ndarray, counted: list[tuple[np.ndarray, np.ndarray]], real: float) -> Index:
    """``index`` with examples: ids, labels, places of terms with counts. ``real``: the share of toxic rows, which examples may have in another."""
    n, n1 = len(ids), int(toxic.sum())
    vectors = [index.scaled(*c) for c in counted]
    kept = index.build(ids, toxic, vectors)
    index.alone = float((real * n + 0.1) / (n + 1.0)) if n1 else 0.0
    votes = []
    for i in range(0, len(kept), BATCH):
        votes += [index.vote(x) for x in index.nearest([vectors[j] for j in kept[i : i + BATCH]], list(range(i, min(i + BATCH, len(kept)))))]
    some = np.array([v is not None for v in votes], bool)
    if some.any():
        y = index.labels[some]
        often = np.where(y == 1, real * n / max(1, n1), (1 - real) * n / max(1, n - n1))
        index.curve = fitted_curve(np.array([v for v in votes if v is not None]), y, often)
    return index


def train(docs: DataFrame, labels: DataFrame, keep, sample: int = SAMPLE) -> Index:
    """An index of labelled documents (doc_id, text; doc_id, toxic) whose doc_id fulfils ``keep``."""
    few_rows_a_batch(docs.sparkSession)
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    labelled = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & keep).groupBy("doc_id").agg((F.max("toxic") == 1).cast(INT).alias("__toxic"))
    labelled = labelled.withColumn("__h", order)
    total = {r[0]: r[1] for r in labelled.groupBy("__toxic").count().collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    least = int(sample * LEAST_SHARE)
    toxic = min(total.get(1, 0), max(least, min(round(sample * share), sample - least)))
    take = {1: toxic, 0: min(total.get(0, 0), sample - toxic)}
    parts = [labelled.filter(F.col("__toxic") == y).orderBy("__h", "doc_id").limit(n) for y, n in take.items()]
    chosen = parts[0].unionAll(parts[1]).drop("__h")
    pairs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows are broadcast
    pairs = durable(pairs.groupBy("doc_id", "__toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "__toxic"))
    kinds = schema(term=LONG, toxic=LONG, clean=LONG)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            y = np.array(b.column("__toxic").to_pylist(), np.int64)
            found = [term_counts(t)[0] for t in texts(b.column("text"))]
            terms, at = np.unique(np.concatenate(found), return_inverse=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            toxic_ = np.bincount(at, np.repeat(y, [len(f) for f in found]), len(terms)).astype(np.int64)
            yield batch_of(kinds, {"term": pa.array(terms.view(np.int64)), "toxic": pa.array(toxic_), "clean": pa.array(np.bincount(at, minlength=len(terms)) - toxic_)})

    seen = pairs.mapInArrow(count, kinds).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()  # the sample's terms
    size = {r[0]: r[1] for r in pairs.groupBy("__toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 + n0:
        return Index(np.zeros(0, np.uint64), np.zeros(0))
    hashes = seen["term"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    vocabulary = hashes[order]
    index = Index(vocabulary, weights_of(*(seen[c].to_numpy()[order].astype(float) for c in ("toxic", "clean")), n1, n0))
    vector_kinds = schema(doc_id=LONG, toxic=INT, t=T.BinaryType(), n=T.BinaryType())

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows = [term_counts(x) for x in texts(b.column("text"))]
            yield batch_of(vector_kinds, {"doc_id": b.column("doc_id"), "toxic": b.column("__toxic"), "t": [np.searchsorted(vocabulary, t).astype(np.int32).tobytes() for t, _ in rows], "n": [n.astype(np.int32).tobytes() for _, n in rows]})

    got = pairs.mapInArrow(counts, vector_kinds).toArrow().sort_by("doc_id")  # at most ``sample`` rows
    counted = [(np.frombuffer(t, np.int32).astype(np.int64), np.frombuffer(n, np.int32)) for t, n in zip(got["t"].to_pylist(), got["n"].to_pylist(), strict=True)]
    return learned(index, got["doc_id"].to_numpy(), got["toxic"].to_numpy().astype(np.int64), counted, share)


def score(docs: DataFrame, index: Index, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``carry`` with score, predicted and evidence (ids of the nearest examples)."""
    few_rows_a_batch(docs.sparkSession)
    chosen = docs.select(*carry, "text")
    kinds = T.StructType([*chosen.schema.fields[:-1], *schema(score=DOUBLE, predicted=INT, evidence=T.ArrayType(LONG)).fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = index.scores(texts(b.column("text")))
            yield batch_of(kinds, {c: b.column(c) for c in carry} | {"score": [s for s, _ in out], "predicted": [int(s >= 0.5) for s, _ in out], "evidence": [e for _, e in out]})

    return chosen.mapInArrow(rows, kinds)


def accepted(docs: DataFrame, index: Index) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't predicted toxic."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            yield b.filter(pa.array([s < 0.5 for s, _ in index.scores(texts(b.column("text")))], pa.bool_()))

    few_rows_a_batch(docs.sparkSession)
    return docs.mapInArrow(rows, docs.schema)


#: Learning leaves this fold of 5 out.
HELD_OUT = (5, 0)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = crc_fold("doc_id", HELD_OUT[0]) == HELD_OUT[1]
    index = train(docs, labels, ~held)
    return score(docs.withColumn("held_out", held.cast(BOOL)), index, ("doc_id", "held_out"))
