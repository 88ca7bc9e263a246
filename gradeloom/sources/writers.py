"""Writers: JSON lines, ordered submissions, part files, ledgers, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joining import require
from . import ledgers


def jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def submission(rows: DataFrame, order: DataFrame, path: str, key: str = "id", position: str = "position") -> None:
    """key and response as one CSV file in the order of ``order`` (key, position); an error if a key of it is missing. For files of report size."""
    whole = require(order.select(key, position), rows.select(key, "response"), key)
    whole.orderBy(position).select(key, "response").coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def append(rows: DataFrame, path: str, batch: str | None = None) -> bool:
    """Adds rows to a ledger as one file; see ``ledgers``. ``readers.csv`` reads it."""
    return ledgers.append(rows, path, batch, files=1)


def copied(spark: SparkSession, source: str, target: str) -> None:
    """A Parquet table written again, unchanged."""
    spark.read.parquet(source).write.mode("overwrite").parquet(target)


def parts(rows: DataFrame, path: str, part: str = "part") -> None:
    """A folder a part number; see ``splitting.part_numbers``."""
    rows.repartition(part).write.mode("overwrite").partitionBy(part).json(path)


def by_group(rows: DataFrame, path: str, group: str) -> None:
    """A folder a group, e.g. of transitions."""
    rows.write.mode("overwrite").partitionBy(group).json(path)


def figure(c: Column) -> Column:
    """A number in up to eight significant digits; "" if null or not finite."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "").otherwise(F.format_string("%.8g", c))


def wide_csv(rows: DataFrame, path: str) -> None:
    """CSV of rows with a union of columns, numbers as ``figure`` writes them."""
    rows.select(*(figure(F.col(c)).alias(c) if k == "double" else F.col(c) for c, k in rows.dtypes)).write.mode("overwrite").csv(path, header=True, emptyValue="")


def manifest(counts: DataFrame) -> str:
    """One row as a JSON object."""
    return counts.select(F.to_json(F.struct(*counts.columns))).first()[0]
