"""Cutting a plan in two: what is used more than once is written once, to the folder that all machines share, and read back."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """Neither spark.checkpoint.dir nor a checkpoint folder of the context is set."""


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the folder that the context was given; without any, a local session, as in tests, takes a temporary folder
    of this machine, and a cluster gets an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


#: Tables of the innermost block of this thread.
_own: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("tables of a block", default=None)


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` as Parquet in the shared folder. Lost executors cost nothing that was written. Within ``passing`` the table goes when that block ends."""
    path = f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    if (own := _own.get()) is not None:
        own.append(path)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def many(rows: DataFrame) -> DataFrame:
    """Rows that a join must shuffle, as they may be many: a cut table's files say little of its size, as keys and flags are a byte a row or less there, and Spark would broadcast millions."""
    return rows.hint("shuffle_merge")


def spread(rows: DataFrame, least: int = 32) -> DataFrame:
    """Rows dealt over four tasks a core, ``least`` at least, before work that costs much a row: a file of few row groups is read by as few tasks, however many rows it has."""
    return rows.repartition(max(least, 4 * rows.sparkSession.sparkContext.defaultParallelism))


def kept(make: Callable[[], DataFrame], path: str | None, spark: SparkSession) -> DataFrame:
    """A table that outlives its run: read if it is at ``path`` whole, else made and written there, so that what makes it isn't asked twice. Without a path it is ``cut``."""
    if path is None:
        return cut(make())
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """A block whose results are safely written elsewhere before it ends: what ``cut`` writes in it, in this thread, is deleted then; nothing of anyone else's is."""
    own: list[str] = []
    token = _own.set(own)
    try:
        yield own
    finally:
        _own.reset(token)
        for name in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
