"""Helpers that several training-data operators use: table reads, durable cuts, row keys, vectorised token hashing.

Every operator selects the columns it needs before it does anything else, so extra columns of a table,
whatever their names, never meet an operator's own columns.
"""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run without ASCII white space (tab to carriage return, space).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD_PATTERN)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


class NoSharedFolder(RuntimeError):
    """Neither spark.checkpoint.dir nor a checkpoint folder of the context is set."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the one that the context was given; without any, a local session
    takes a temporary folder of this machine, and a cluster gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once, compressed, to the shared folder and read back: lineage ends there and lost executors cost nothing.

    Rows and values are kept; their partitioning isn't. Within ``passing`` the table goes when that block ends, else it stays.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    if (own := _own.get()) is not None:
        own.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of the innermost block of this thread.
_own: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("tables of a block", default=None)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """A block whose results are safely written elsewhere before it ends: what ``durable`` writes in it, in this thread, is deleted then; nothing of anyone else's is."""
    own: list[str] = []
    token = _own.set(own)
    try:
        yield own
    finally:
        _own.reset(token)
        for name in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` after ``checkpoint()``: rows stay in the partitions, and in the order, that they have now."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def matched(rows: DataFrame, values: DataFrame, key: str, parts: int = 1_000) -> DataFrame:
    """``rows`` with the other columns of ``values`` (at most a row a key), null where it has none.

    A key that holds at least a ``parts``-th of all rows is joined by broadcast: there are at most ``parts`` such keys, whatever the input. The other
    keys are too small to fill a task and are shuffled; rows with a null key, however many, match nothing and stay where they are. ``rows`` is read several times.
    """
    there = rows.filter(F.col(key).isNotNull())
    sizes = there.groupBy(key).agg(F.count("*").alias("__n")).filter("__n > 1")
    total = rows.agg(F.count("*").alias("__all"))
    hot = sizes.filter(F.col("__n") * parts >= total.first()[0]).select(key)  # at most ``parts`` rows
    new = [c for c in values.columns if c != key]
    cold = there.join(F.broadcast(hot), key, "left_anti").join(values, key, "left")
    few = F.broadcast(values.join(F.broadcast(hot), key, "left_semi"))
    warm = there.join(F.broadcast(hot), key, "left_semi").join(few, key, "left")
    none = rows.filter(F.col(key).isNull()).select("*", *(F.lit(None).cast(values.schema[c].dataType).alias(c) for c in new))
    return cold.unionByName(warm).unionByName(none)


def crc_fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")).cast("binary")) % folds


def crc_fold_of(doc_id: int | None, folds: int) -> int:
    """The same in Python."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings, "" for null."""
    return [t or "" for t in column.to_pylist()]


#: Rows of a batch of texts that goes between the JVM and Python; a batch of whole documents takes megabytes, not tens of them, on both sides.
BATCH_ROWS = 1_000


def few_rows_a_batch(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold ``BATCH_ROWS`` rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def small_batches(batches: Iterator[pa.RecordBatch], size: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that a batch of very long texts doesn't grow Python copies beyond ``size`` bytes or so."""
    for b in batches:
        n = max(1, min(b.num_rows, int(b.num_rows * size / max(1, b.nbytes))))
        for i in range(0, b.num_rows, n):
            yield b.slice(i, n)
    tidy()


def tidy() -> None:
    """Gives memory that a task has freed back to the machine: a worker lives on between tasks, and idle ones would add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Random odd multipliers by a byte's place in its word, and random values of the bytes.
_places = np.zeros(0, np.uint64)
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def place_numbers(n: int) -> np.ndarray:
    """The first n of the multipliers by place."""
    global _places
    if len(_places) >= n:
        return _places[:n]
    size = max(1 << 12, 1 << int(n - 1).bit_length())
    with np.errstate(over="ignore"):
        made = mix64((np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    if size <= 1 << 20:
        _places = made
    return made[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


_HASHED = _VALUES.copy()
_HASHED[65:91] = _VALUES[97:123]
_HASHED[_SPACE] = 0


def word_hashes(text: str | bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order; A-Z count as a-z.

    Sums of random values of bytes, each times a random odd number for its place in the word, finalised: one pass of numpy hashes all words of a text, and no
    family of words collides by its form. Of n different words any two share a hash with a chance near n*n / 2**65.
    """
    raw = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    starts, ends = word_spans(raw)
    if not len(starts):
        return np.empty(0, np.uint64)
    bounds = np.append(starts, len(raw))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(bounds))
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_HASHED[raw[starts[0] :]] * place_numbers(int(place.max()) + 1)[place], starts - starts[0])
        return mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words(text: str) -> list[str]:
    return _WORD.findall(text)


LONG, STRING, DOUBLE, INT, BOOL = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def batch_of(kinds: T.StructType, columns: dict[str, object]) -> pa.RecordBatch:
    """A record batch in the order and the types of ``kinds``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else (c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)) for f in arrow], schema=arrow)
