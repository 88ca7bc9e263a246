"""A corpus pipeline: language, toxicity, near duplicates, mixing, tokens. Each stage works on all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, extra ones included, whatever their names. Empty tables pass through every stage. Rows with a
null id are documents like others; repeated rows are judged alike. What a stage wrote for itself is deleted once its result is written, and a result once
the next one is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import bpe, jaccard, langid, mixing, toxicity
from gradeloom.llm.shared import crc_fold, passing, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay; those without a letter (null and empty texts too), or of which the model can't tell, go.

    Without labelled documents, or with none that has a letter, no language is known and every document goes.
    """
    folds, held = langid.HELD_OUT
    model = langid.train(docs.select("doc_id", "text", "lang"), crc_fold("doc_id", folds) != held)
    return langid.accepted(docs, model)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Null and empty texts have the share of toxic examples for a score; without labels of these documents all stay."""
    folds, held = toxicity.HELD_OUT
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.accepted(docs, toxicity.train(docs.select("doc_id", "text"), labels, crc_fold("doc_id", folds) != held))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest doc_id, null ids last. Texts without words are like no other and stay."""
    return jaccard.one_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: for each document and output shard the blocks of it that the shard takes. Texts without words, and documents of which nothing is taken, have no row."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers) and digests of each row's text; null and empty texts have 0 tokens."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", unlike), ("mixing", mixture), ("tokens", tokens)]

#: Trained models, hashing and byte-pair ranks can't be expressed in SQL.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again. An empty result keeps its columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            result = stage(spark, docs, sf_dir)
            return result.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", F.length("ids").alias("n_bytes"))
        path = f"{folder}/{i}-{name}"
        with passing(spark):
            result = stage(spark, docs, sf_dir)
            result.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs
