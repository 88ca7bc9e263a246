"""Ledgers: tables that grow by appends, of which a reader sees whole ones only.

A ledger is a folder with a subfolder of CSV files, each with a header, for each append, and a manifest: one small JSON file for each append that ended, put there by a
rename once its rows are written. Readers take what the manifest names; what a failed, killed or speculative write has left is in no manifest and is never seen.
Appends don't wait for each other. An append with a ``batch`` that the manifest has already changes nothing, so one that isn't known to have ended
can be made again.

The driver reads one manifest entry an append. An empty text comes back as null, as in any CSV. Columns may differ between appends: a reader's schema decides, and what an append hasn't is null.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST, ROWS = "_manifest", "_rows"


class BadLedger(ValueError):
    """A manifest names files that aren't there, or in a form that isn't known."""


def _at(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def is_ledger(spark: SparkSession, path: str) -> bool:
    p, files = _at(spark, f"{path}/{MANIFEST}")
    return bool(files.exists(p))


def commit(spark: SparkSession, path: str, batch: str, entry: dict[str, object]) -> bool:
    """Puts an append into the manifest, whole or not at all; False if the batch is there already."""
    final, files = _at(spark, f"{path}/{MANIFEST}/{batch}.json")
    if files.exists(final):
        return False
    draft, _ = _at(spark, f"{path}/{MANIFEST}/_{batch}-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(entry, ensure_ascii=False).encode()))
    out.close()
    if files.rename(draft, final):
        return True
    files.delete(draft, False)
    return False


def append(rows: DataFrame, path: str, batch: str | None = None, files: int | None = None) -> bool:
    """Adds all rows, or none. ``batch``: a name for this append; False if the ledger has it already. ``files``: how many files, else as the rows are dealt."""
    spark = rows.sparkSession
    batch = batch or uuid.uuid4().hex
    if not re.fullmatch(r"[\w.-]+", batch) or batch[0] in "_.":
        raise ValueError(f"not a name for a batch: {batch}")
    if any(e["batch"] == batch for e in entries(spark, path)):
        return False
    folder = f"{ROWS}/{batch}-{uuid.uuid4().hex}"
    seen = Observation()
    counted = (rows if files is None else rows.coalesce(files)).observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.csv(f"{path}/{folder}", header=True, escape='"')
    return commit(spark, path, batch, {"batch": batch, "at": time.time(), "rows": seen.get["n"], "folder": folder, "columns": rows.columns})


def entries(spark: SparkSession, path: str) -> list[dict[str, object]]:
    """The manifest, in order of time."""
    p, files = _at(spark, f"{path}/{MANIFEST}/*.json")
    found = []
    for status in files.globStatus(p) or []:
        if status.getPath().getName().startswith("_"):
            continue
        stream = files.open(status.getPath())
        try:
            found.append(json.loads(bytes(stream.readNBytes(status.getLen()))))
        except ValueError as error:
            raise BadLedger(str(status.getPath())) from error
        finally:
            stream.close()
    return sorted(found, key=lambda e: (e["at"], e["batch"]))


def read(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """All rows of the appends that ended; none if there is no ledger. Columns are found by name, whatever their order in an append."""
    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    by_columns: dict[tuple[str, ...], list[str]] = {}
    for e in entries(spark, path):
        folder = f"{path}/{e['folder']}"
        p, files = _at(spark, folder)
        if not files.exists(p):
            raise BadLedger(f"{folder} is in the manifest and isn't there")
        by_columns.setdefault(tuple(e["columns"]), []).append(folder)
    out = spark.createDataFrame([], want)
    kinds = {f.name: f.dataType for f in want}
    for columns, folders in by_columns.items():
        own = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in columns])
        rows = spark.read.schema(own).csv(folders, header=True, multiLine=True, escape='"')
        out = out.unionByName(rows.select(*(F.col(f"`{f.name}`") if f.name in columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want)))
    return out


def swept(spark: SparkSession, path: str, older: float) -> int:
    """Deletes rows that no manifest names and that are older than so many seconds (an append under way is younger); how many appends' rows those were."""
    named = {e["folder"].rsplit("/", 1)[-1] for e in entries(spark, path)}
    p, files = _at(spark, f"{path}/{ROWS}/*")
    gone = 0
    for status in files.globStatus(p) or []:
        if status.getPath().getName() not in named and time.time() - status.getModificationTime() / 1000 > older:
            gone += bool(files.delete(status.getPath(), True))
    return gone
