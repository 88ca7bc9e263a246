"""Quality of texts by a generalised additive model with pairwise interactions.

A text becomes some twenty numbers (``FEATURES``), all from one pass of numpy over its bytes. The model is a table a number and a table a pair of numbers:
a text's score is the logistic of an intercept plus an entry of each table, where its bins say. Tables are learned by cyclic boosting: round after round
each number in turn gets a shallow tree on the gradient of the log loss, summed by bin, at a small rate, so that no number takes what another explains as well; a tree
over bins is a few steps of a table, so what is learned is the table. Rounds end when the log loss on a fifth of the sample, kept out, hasn't fallen for some rounds.
Then the pairs whose four quadrants explain most of what is left get tables by the same boosting. Tables are centred, so the intercept is the mean log odds.

Learning takes a bounded sample of labelled rows: about ``sample``, a parameter, by the hash of their id, of each label an eighth of it at least, as far as there
are such rows; losses weigh labels as often as they really are. The features of these rows come to the driver, and the model's size is fixed whatever the input.
Scoring is one pass over the texts where they lie; nothing is shuffled.

Defined cases: null and empty texts have zeros for all features and are scored like others. A label that is null doesn't count; of repeated labels of an id the largest counts;
of repeated documents with one id the sample takes the least features. Without labelled rows every score is 0.5; with one label only every score
is near it. Ties between splits and between pairs go to the first. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BOOL, DOUBLE, INT, LONG, batch_of, crc_fold, few_rows_a_batch, schema, small_batches, word_hashes, word_spans

SAMPLE, LEAST_SHARE = 20_000, 0.125
FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "different_words", "top_word", "repeated_neighbours", "capitals", "digits", "marks", "stops", "spaces", "not_ascii",
    "words_ending_in_marks", "words_ending_in_shouts", "words_of_marks", "words_in_capitals", "short_words", "line_length", "repeated_lines", "closed_lines", "different_bytes",
)
_LETTER, _CAPITAL, _DIGIT, _BLANK, _STOP, _MARK, _REST = range(7)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LETTER, _CAPITAL, _DIGIT, _REST
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[list(b".,;:?!'\"()-")] = _STOP


def features(text: bytes) -> list[float]:
    """The numbers of a text in UTF-8, in the order of ``FEATURES``."""
    raw = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(raw)
    n = len(starts)
    if not n:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(FEATURES) - 1)
    kind = _CLASS[raw]
    letter, capital, digit, blank, stop, mark, rest = np.bincount(kind, minlength=7).tolist()
    size, length = len(raw), ends - starts
    hashes = word_hashes(text)
    counts = np.unique(hashes, return_counts=True)[1]
    last = kind[ends - 1]
    capitals = np.add.reduceat((kind == _CAPITAL).astype(np.int32), starts)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(size)), float(np.log(n)), float(length.mean()), float(length.std()), len(counts) / n, int(counts.max()) / n, float((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0.0,
        capital / max(1, letter + capital), digit / size, mark / size, stop / size, blank / size, rest / size,
        float((last == _MARK).mean()), float((raw[ends - 1] == 33).mean()), float((last[length == 1] == _MARK).sum() / n), float((capitals > 1).mean()), float((length <= 3).mean()),
        size / len(lines), 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), float(np.count_nonzero(np.bincount(raw, minlength=256))),
    ]


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def log_loss(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The mean log loss of log odds."""
    return float((w * (np.logaddexp(0, z) - y * z)).sum() / max(1e-12, w.sum()))


@dataclass
class Model:
    """Bin edges of each feature, tables of features, and pairs (i, j) with tables over their coarser bins."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features: one look-up and one addition a table, for all rows at once."""
        z = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], "right") for p in self.pairs for j in p}
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[coarse[i], coarse[j]]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.log_odds(x))

    def reasons(self, x: np.ndarray, most: int = 3) -> list[list[tuple[str, float]]]:
        """For each row the terms that move its log odds most."""
        names = [*FEATURES[: len(self.tables)], *(f"{FEATURES[i]} x {FEATURES[j]}" for i, j in self.pairs)]
        parts = [t[np.searchsorted(e, x[:, j], "right")] for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True))]
        parts += [t[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")] for (i, j), t in zip(self.pairs, self.pair_tables, strict=True)]
        each = np.array(parts).T.reshape(len(x), len(parts))
        return [[(names[k], float(r[k])) for k in np.argsort(-np.abs(r), kind="stable")[:most]] for r in each]


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts that give at most ``bins`` bins, of near equal counts where values allow; halfway between neighbouring values."""
    values, counts = np.unique(x, return_counts=True)
    if len(values) <= 1:
        return np.empty(0)
    ends = np.cumsum(counts)[:-1]
    at = np.unique(np.searchsorted(ends, np.arange(1, bins) * len(x) / bins))
    at = at[at < len(ends)]
    return (values[at] + values[at + 1]) / 2


def gain(g: np.ndarray, h: np.ndarray, hold: float) -> np.ndarray:
    return g * g / (h + hold)


def split(g: np.ndarray, h: np.ndarray, hold: float, least: float) -> tuple[float, int]:
    """How much the best cut of a row of bins gains, and its place: bins before it go left. Both sides must weigh ``least``; no gain: place 0."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    won = np.where((hl >= least) & (hr >= least), gain(gl, hl, hold) + gain(gr, hr, hold) - gain(g.sum(), h.sum(), hold), 0.0)
    if not len(won) or won.max() <= 1e-12:
        return 0.0, 0
    at = int(np.argmax(won))
    return float(won[at]), at + 1


def tree(g: np.ndarray, h: np.ndarray, leaves: int, hold: float, least: float) -> np.ndarray:
    """A step a leaf over a row of bins with gradients g and curvatures h, grown best gain first."""
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        found = [(*split(g[a:z], h[a:z], hold, least), a, z) for a, z in parts]
        won, at, a, z = max(found, key=lambda f: f[0])
        if not at:
            break
        i = parts.index((a, z))
        parts[i : i + 1] = [(a, a + at), (a + at, z)]
    out = np.empty(len(g))
    for a, z in parts:
        out[a:z] = -g[a:z].sum() / (h[a:z].sum() + hold)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, hold: float, least: float) -> tuple[np.ndarray, float]:
    """Four leaves over a table of bins: a cut along one axis, then one of each side along the other; and what it gains."""
    best: tuple[float, np.ndarray] = (0.0, np.full(g.shape, -g.sum() / (h.sum() + hold)))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        ga, ha = np.cumsum(a, 0)[:-1], np.cumsum(b, 0)[:-1]
        for at in range(1, len(a)):
            won, out = -float(gain(g.sum(), h.sum(), hold)), np.empty(a.shape)
            for rows, gs, hs in ((slice(0, at), ga[at - 1], ha[at - 1]), (slice(at, None), a.sum(0) - ga[at - 1], b.sum(0) - ha[at - 1])):
                _, cut = split(gs, hs, hold, least)
                for part in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
                    out[rows, part] = -gs[part].sum() / (hs[part].sum() + hold)
                    won += float(gain(gs[part].sum(), hs[part].sum(), hold))
            if won > best[0] + 1e-12:
                best = won, out.T if turned else out
    return best[1], best[0]


def boosted(z: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray, bins: list[np.ndarray], shapes: list[tuple[int, ...]], rate: float, rounds: int, patience: int, hold: float, least: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Tables of terms (bins of each row, number of bins) by cyclic boosting on the rows that aren't ``held``, from log odds z; the tables of the round with the least
    loss on the held ones, and the log odds that they give."""
    tables, best = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    z, lowest, since = z.copy(), log_loss(z[held], y[held], w[held]), 0
    best_z, learn = z.copy(), ~held
    for _ in range(rounds):
        for t, (at, shape) in enumerate(zip(bins, shapes, strict=True)):
            p = logistic(z[learn])
            size = int(np.prod(shape))
            g = np.bincount(at[learn], w[learn] * (p - y[learn]), size).reshape(shape)
            h = np.bincount(at[learn], w[learn] * p * (1 - p), size).reshape(shape)
            step = rate * (tree(g, h, 3, hold, least) if len(shape) == 1 else pair_tree(g, h, hold, least)[0])
            tables[t] += step
            z += step.ravel()[at]
        loss = log_loss(z[held], y[held], w[held])
        if loss < lowest - 1e-7:
            lowest, since, best, best_z = loss, 0, [t.copy() for t in tables], z.copy()
        else:
            since += 1
            if since >= patience:
                break
    return best, best_z


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, bins: int = 32, pair_bins: int = 8, pairs: int = 8, rate: float = 0.1, rounds: int = 300, patience: int = 20, hold: float = 1.0, least: float = 0.5) -> Model:
    """A model of rows of features with labels 0 and 1 and weights, in a fixed order; every fifth row is held out to end the rounds."""
    model = Model(edges=[quantile_edges(c, bins) for c in x.T], pair_edges=[quantile_edges(c, pair_bins) for c in x.T])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    share = (w @ y + 0.5) / (w.sum() + 1)
    model.intercept = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return model
    held = np.arange(len(y)) % 5 == 0
    held = held if len(np.unique(y[held])) == 2 and len(np.unique(y[~held])) == 2 else np.zeros(len(y), bool)
    if not held.any():
        rounds = min(rounds, 50)  # too few rows to hold any out
    fine = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T, strict=True)]
    coarse = [np.searchsorted(e, c, "right") for e, c in zip(model.pair_edges, x.T, strict=True)]
    z = np.full(len(y), model.intercept)
    check = held if held.any() else np.ones(len(y), bool)
    teach = held if held.any() else np.zeros(len(y), bool)

    def run(z, at, shapes, rounds):
        if teach.any():
            return boosted(z, y, w, teach, at, shapes, rate, rounds, patience, hold, least)
        doubled = [np.concatenate([a, a]) for a in at]  # learn and end on the same rows
        mark = np.repeat([False, True], len(y))
        tables, zz = boosted(np.tile(z, 2), np.tile(y, 2), np.tile(w, 2), mark, doubled, shapes, rate, rounds, patience, hold, least)
        return tables, zz[: len(y)]

    model.tables, z = run(z, fine, [t.shape for t in model.tables], rounds)
    p = logistic(z)
    g, h = w * (p - y), w * p * (1 - p)
    found = []
    for i, j in combinations(range(x.shape[1]), 2):
        shape = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
        at, learn = coarse[i] * shape[1] + coarse[j], ~teach
        found.append((-pair_tree(*(np.bincount(at[learn], v[learn], shape[0] * shape[1]).reshape(shape) for v in (g, h)), hold, least)[1], i, j, at, shape))
    found.sort(key=lambda f: f[:3])
    chosen = [f for f in found[:pairs] if f[0] < 0]
    model.pairs = [f[1:3] for f in chosen]
    model.pair_tables, z = run(z, [f[3] for f in chosen], [f[4] for f in chosen], rounds)
    for tables, at in ((model.tables, fine), (model.pair_tables, [f[3] for f in chosen])):
        for t, b in zip(tables, at, strict=True):
            mean = float(w @ t.ravel()[b] / w.sum())
            t -= mean
            model.intercept += mean
    assert np.allclose(model.log_odds(x[check]), z[check])
    return model


def table_of(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Columns ``carry`` and the features x of documents (text)."""
    chosen = docs.select(*carry, F.col("text").cast("binary").alias("text"))
    kinds = T.StructType([*chosen.schema.fields[:-1], T.StructField("x", T.ArrayType(DOUBLE))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            yield batch_of(kinds, {c: b.column(c) for c in carry} | {"x": [features(t or b"") for t in b.column("text").to_pylist()]})

    few_rows_a_batch(docs.sparkSession)
    return chosen.mapInArrow(rows, kinds)


def train(docs: DataFrame, labels: DataFrame, keep, sample: int = SAMPLE, **parameters: float) -> Model | None:
    """A model of labelled documents (doc_id, text; doc_id, quality) whose doc_id fulfils ``keep``; None if there are none."""
    labelled = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & keep).groupBy("doc_id").agg((F.max("quality") == 1).cast(INT).alias("__y"))
    total = {r[0]: r[1] for r in labelled.groupBy("__y").count().collect()}
    if not total:
        return None
    every = sum(total.values())
    # Hashes are spread evenly over the longs: so many of a label lie under its cut, give or take the square root.
    cuts = {y: min((1 << 63) - 1, -(1 << 63) + (1 << 64) * max(round(sample * LEAST_SHARE), round(sample * n / every)) // n) for y, n in total.items()}
    cut = F.when(F.col("__y") == 1, cuts.get(1, 0)).otherwise(cuts.get(0, 0))
    chosen = labelled.filter(F.xxhash64("doc_id", F.lit(23)) <= cut)
    pairs = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about ``sample`` rows are broadcast
    got = table_of(pairs, ("doc_id", "__y")).groupBy("doc_id", "__y").agg(F.min("x").alias("x")).toArrow()  # about ``sample`` rows
    if not got.num_rows:
        return None
    rows = sorted(zip(got["doc_id"].to_pylist(), got["__y"].to_pylist(), got["x"].to_pylist(), strict=True))
    y = np.array([r[1] for r in rows], float)
    real, share = total.get(1, 0) / every, y.mean()
    w = np.where(y == 1, real / max(1e-12, share), (1 - real) / max(1e-12, 1 - share))
    # Rows in an order that has nothing to do with ids, so that every fifth is a fair fifth.
    order = np.random.default_rng(11).permutation(len(rows))
    return fit(np.array([r[2] for r in rows])[order], y[order], w[order], **parameters)


def score(docs: DataFrame, model: Model | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``carry`` with score, predicted and reasons (the terms that move the score most, with their log odds)."""
    chosen = docs.select(*carry, F.col("text").cast("binary").alias("text"))
    why = T.ArrayType(schema(term=T.StringType(), log_odds=DOUBLE))
    kinds = T.StructType([*chosen.schema.fields[:-1], *schema(score=DOUBLE, predicted=INT, reasons=why).fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            x = np.array([features(t or b"") for t in b.column("text").to_pylist()]).reshape(b.num_rows, len(FEATURES))
            p = model.scores(x) if model else np.full(len(x), 0.5)
            reasons = [[{"term": n, "log_odds": v} for n, v in r] for r in model.reasons(x)] if model else [[]] * len(x)
            yield batch_of(kinds, {c: b.column(c) for c in carry} | {"score": p, "predicted": (p >= 0.5).astype(np.int32), "reasons": reasons})

    few_rows_a_batch(docs.sparkSession)
    return chosen.mapInArrow(rows, kinds)


#: Learning leaves this fold of 3 out.
HELD_OUT = (3, 1)


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held = crc_fold("doc_id", HELD_OUT[0]) == HELD_OUT[1]
    model = train(docs, labels, ~held)
    return score(docs.withColumn("held_out", held.cast(BOOL)), model, ("doc_id", "held_out"))
