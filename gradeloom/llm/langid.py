"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text are hashed into a fixed number of buckets; a text's vector is
log(1 + count) * idf, scaled to length 1. Weights are trained by follow-the-regularised-leader (per-coordinate steps, L1 and L2
penalties), so that most stay exactly 0; a temperature fitted on documents that training didn't see calibrates the probabilities.

Training takes a bounded sample of labelled documents, about ``sample`` of them by each language's share and about ``least`` of each language at least (both
parameters), so that a rare language is learned too: those whose hash of id and text is small enough, copies counting once. Their sparse vectors, not
their texts, come to the driver; the model has a fixed size a language whatever the input.
Prediction is one pass over the texts where they lie; nothing is shuffled.

Defined cases: a null text, or one without a letter, is ``und`` with score 1.0. If no labelled document has a letter,
every text is ``und`` with score 0.0. Ties go to the language that comes first. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BOOL, DOUBLE, LONG, STRING, batch_of, crc_fold, few_rows_a_batch, schema, small_batches

BUCKETS = 1 << 14
UNKNOWN = "und"


def features(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character 1- to 3-grams of a text, and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        grams = [codes * np.uint64(0x9E3779B97F4A7C15)]
        for n in (2, 3):
            if len(codes) >= n:
                grams.append((grams[-1][:-1] ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9) + codes[n - 1 :] * np.uint64(0x94D049BB133111EB))
        at = np.concatenate(grams) >> np.uint64(64 - (buckets - 1).bit_length())
    counts = np.bincount(at.astype(np.int64), minlength=buckets)
    where = np.flatnonzero(counts)
    return where, counts[where]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages, mostly 0
    bias: np.ndarray
    temperature: float

    def vector(self, where: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[where]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def logits(self, where: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(where, counts) @ self.weights[where] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not has_letter(text):
            return UNKNOWN, 1.0
        if not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*features(text, len(self.idf))) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(min(1.0, p[k]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], buckets: int = BUCKETS, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """rows: language, buckets and counts of each training text, in a fixed order. Every fifth text is left for the temperature."""
    languages = sorted({r[0] for r in rows})
    df = np.zeros(buckets)
    for _, where, _ in rows:
        df[where] += 1
    model = Model(languages, np.log((1 + len(rows)) / (1 + df)) + 1, np.zeros((buckets, len(languages))), np.zeros(len(languages)), 1.0)
    if len(languages) < 2:
        return model
    label = {x: i for i, x in enumerate(languages)}
    vectors = [(where, model.vector(where, counts), label[x]) for x, where, counts in rows]
    train = [v for i, v in enumerate(vectors) if i % 5 or len(vectors) < 25]
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    zb, nb = np.zeros(len(languages)), np.zeros(len(languages))

    def leader(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            where, x, y = train[i]
            w, b = leader(z[where], n[where], l1), leader(zb, nb, 0.0)
            g = softmax(x @ w + b)
            g[y] -= 1
            gw = x[:, None] * g
            for zz, nn, ww, gg in ((z, n, w, gw), (zb, nb, b, g)):
                at = where if zz is z else slice(None)
                sigma = (np.sqrt(nn[at] + gg * gg) - np.sqrt(nn[at])) / alpha
                zz[at] += gg - sigma * ww
                nn[at] += gg * gg
    model.weights, model.bias = leader(z, n, l1), leader(zb, nb, 0.0)
    held = [v for i, v in enumerate(vectors) if not i % 5] if len(vectors) >= 25 else vectors
    logits, y = np.array([x @ model.weights[where] + model.bias for where, x, _ in held]), np.array([v[2] for v in held])
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return model


def train(docs: DataFrame, keep, sample: int = 2000, least: int = 100, buckets: int = BUCKETS, **parameters: float) -> Model:
    """A model from documents (doc_id, text, lang) where ``keep`` holds and lang is there."""
    few_rows_a_batch(docs.sparkSession)
    order = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(11))
    labelled = docs.filter(keep & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", order.alias("h"))
    # Distinct hashes, so copies of one row, however many, are one row of the sample. A row a language comes to the driver.
    sizes = {r[0]: r[1] for r in labelled.select("lang", "h").distinct().groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros(buckets), np.zeros((buckets, 0)), np.zeros(0), 1.0)
    total = sum(sizes.values())
    # Hashes are spread evenly over the longs: so many of a language lie under its cut, give or take the square root.
    cuts = {lang: min((1 << 63) - 1, -(1 << 63) + (1 << 64) * max(least, round(sample * n / total)) // n) for lang, n in sizes.items()}
    cut = F.try_element_at(F.create_map(*(F.lit(x) for pair in sorted(cuts.items()) for x in pair)), F.col("lang"))
    kinds = schema(h=LONG, lang=STRING, at=T.ArrayType(T.IntegerType()), n=T.ArrayType(T.IntegerType()))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows = [(h, lang, *features(t, buckets)) for lang, t, h in zip(*(c.to_pylist() for c in b.columns), strict=True) if has_letter(t)]
            yield batch_of(kinds, dict(zip(("h", "lang", "at", "n"), map(list, zip(*rows, strict=True)) if rows else ([],) * 4, strict=True)))

    chosen = labelled.filter(F.col("h") <= cut).groupBy("h").agg(F.min("lang").alias("lang"), F.min("text").alias("text")).select("lang", "text", "h")
    got = chosen.mapInArrow(vectors, kinds).toArrow()  # about ``sample`` rows, and ``least`` a language
    rows = sorted(zip(*(got[c].to_pylist() for c in ("h", "lang", "at", "n")), strict=True), key=lambda r: r[:2])
    return fit([(lang, np.array(at, np.int64), np.array(n, np.int64)) for _, lang, at, n in rows], buckets, **parameters)


def predictor(model: Model, kinds: T.StructType, carry: tuple[str, ...], text: str = "text"):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = [model.predict(t) for t in b.column(text).to_pylist()]
            yield batch_of(kinds, {c: b.column(c) for c in carry} | {"lang_pred": [o[0] for o in out], "score": [o[1] for o in out]})

    return rows


def predict(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``carry`` with lang_pred and score."""
    few_rows_a_batch(docs.sparkSession)
    chosen = docs.select(*carry, "text")
    kinds = T.StructType([*chosen.schema.fields[:-1], *schema(lang_pred=STRING, score=DOUBLE).fields])
    return chosen.mapInArrow(predictor(model, kinds, carry), kinds)


def accepted(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a known language with a probability of at least ``least``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = [model.predict(t) for t in b.column("text").to_pylist()]
            yield b.filter(pa.array([lang != UNKNOWN and p >= least for lang, p in out], pa.bool_()))

    few_rows_a_batch(docs.sparkSession)
    return docs.mapInArrow(rows, docs.schema)


#: Learning leaves this fold of 4 out.
HELD_OUT = (4, 2)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = crc_fold("doc_id", HELD_OUT[0]) == HELD_OUT[1]
    model = train(docs, ~held)
    return predict(docs.withColumn("held_out", held.cast(BOOL)), model, ("doc_id", "held_out"))
