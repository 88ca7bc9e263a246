"""Readers: JSON lines, JSON documents, CSV, Parquet, row stores, prediction files, checkpoints. All lazy but where a check needs a count."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cutting import cut
from ..operators.splitting import ranges
from . import ledgers, probing
from .tensors import tensors  # noqa: F401


class BadRows(ValueError):
    """Rows that a strict reader refuses."""


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def jsonl_strict(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """JSON lines; an error that names files and lines if one isn't a JSON object of the schema."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    bad = lines.filter(~F.trim("value").startswith("{") | F.try_parse_json("value").isNull()).limit(5).collect()
    if bad:
        raise BadRows("; ".join(f"{r.file}: {r.value[:80]}" for r in bad))
    out = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    return out.limit(limit) if limit is not None else out


def json_documents(spark: SparkSession, path: str, schema: T.StructType, keys: tuple[str, ...] = ("data", "rows", "examples")) -> DataFrame:
    """Rows of JSON files that hold a list, or an object with a list under one of ``keys``."""
    whole = spark.read.text(path, wholetext=True)
    rows = T.ArrayType(schema)
    listed = F.when(F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("["), F.from_json("value", rows))
    keyed = [F.from_json(F.get_json_object("value", f"$.{k}"), rows) for k in keys]
    return whole.select(F.explode(F.coalesce(listed, *keyed)).alias("r")).select("r.*")


def csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header in every file, or a ledger; quoted line breaks and doubled quotes are kept. A file that isn't there has no rows."""
    if ledgers.is_ledger(spark, path):
        return ledgers.read(spark, path, schema)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def files(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Files of a folder in any store that Spark reads, by name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(str(f.getPath()) for f in found)


def any_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A reader by suffix: .jsonl, .json, .csv or .parquet."""
    kind = path.rsplit(".", 1)[-1]
    if kind == "jsonl":
        return jsonl(spark, path, schema)
    if kind == "json":
        return json_documents(spark, path, schema)
    if kind == "csv":
        return csv(spark, path, schema)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")


def with_position(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with the file and the row within it."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.row_index").alias("source_row"))


def text_columns(rows: DataFrame, hints: tuple[str, ...], least: int = 20, limit: int | None = None) -> DataFrame:
    """``text``: the hinted columns that are there, joined; shorter texts are left out. Other columns aren't read."""
    have = [c for c in rows.columns if c.lower() in hints]
    text = F.concat_ws("\n", *(F.col(c).cast("string") for c in have)) if have else F.lit(None).cast("string")
    out = rows.select(text.alias("text")).filter(F.length("text") >= least)
    return out.limit(limit) if limit is not None else out


def prediction_file(spark: SparkSession, folder: str, preferred: tuple[str, ...] = ("predictions.jsonl", "submission.csv")) -> str:
    """The preferred file, else the only .jsonl, else the only .csv; an error if that doesn't decide."""
    names = {f.rsplit("/", 1)[-1]: f for f in files(spark, folder)}
    for name in preferred:
        if name in names:
            return names[name]
    for suffix in (".jsonl", ".csv"):
        some = [f for n, f in names.items() if n.endswith(suffix)]
        if len(some) == 1:
            return some[0]
    raise FileNotFoundError(f"no single prediction file in {folder}")


def row_store(spark: SparkSession, folder: str, schema: T.StructType, key: str = "id") -> DataFrame:
    """Rows kept one JSON object a file, in order of file names; an error if an id stands twice."""
    rows = spark.read.schema(schema).json(folder, multiLine=True, pathGlobFilter="*.json").select("*", F.col("_metadata.file_name").alias("file_name"))
    twice = rows.groupBy(key).count().filter("count > 1").limit(5).collect()
    if twice:
        raise BadRows(f"repeated ids: {[r[0] for r in twice]}")
    return rows


def newest_checkpoint(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The state file of the checkpoint with the largest number."""
    step = F.regexp_extract("path", r"checkpoint-(\d+)", 1).cast("long")
    rows = spark.read.schema(schema).json(f"{folder}/checkpoint-*/trainer_state.json", multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    return rows.withColumn("step", step).orderBy(F.desc("step")).limit(1)


def union_of(*tables: DataFrame) -> DataFrame:
    """All rows of tables with different columns; missing ones are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def by_precedence(key: str, *tables: DataFrame) -> DataFrame:
    """A row a key, from the first table that has it."""
    ranked = union_of(*(t.withColumn("__p", F.lit(i)) for i, t in enumerate(tables)))
    return ranked.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__p"))).filter("__n = 1").drop("__p", "__n")


def fan_in(spark: SparkSession, paths: list[str], schema: T.StructType, most: int | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Rows of files, or of folders of files, of several formats, with ``source_file``, up to ``most`` of them; and why some files are left out, of which a warning tells too.

    Every file is probed first, by tasks, so that a cut-off or broken one is left out with its reason and no action fails by it.
    """
    within = {p: [f for f in files(spark, p) if f.rsplit("/", 1)[-1][:1] not in "._"] or [p] for p in paths}
    known = {p for p in paths if p.rsplit(".", 1)[-1] in ("jsonl", "json", "csv", "parquet")}
    found = cut(probing.probe(spark, [f for p in paths if p in known for f in within[p]])) if known else None
    bad = {r.path: r.reason for r in found.filter("reason IS NOT NULL").select("path", "reason").collect()} if known else {}
    skipped = {p: "no reader for it" for p in paths if p not in known}
    # An empty file of a folder is a part without rows.
    skipped |= {(p if within[p] == [f] else f): bad[f] for p in known for f in within[p] if f in bad and not (bad[f] == "empty" and within[p] != [p] and f != p)}
    for path, reason in skipped.items():
        warnings.warn(f"left out {path}: {reason}", stacklevel=2)
    sound = {kind: [f for p in paths if p in known for f in within[p] if f not in bad and p.endswith(kind)] for kind in (".parquet", ".csv")}
    tables = [probing.objects(spark, found.filter(F.col("kind").isin("array", "object", "lines")), schema)] if known else []
    file = F.col("_metadata.file_path").alias("source_file")
    if sound[".parquet"]:
        tables.append(spark.read.schema(schema).parquet(*sound[".parquet"]).select("*", file))
    if sound[".csv"]:
        tables.append(spark.read.schema(schema).csv(sound[".csv"], header=True, multiLine=True, escape='"').select("*", file))
    if not tables or len(bad) == sum(len(within[p]) for p in known):
        return None, skipped
    out = union_of(*tables)
    return (out.limit(most) if most is not None else out), skipped


def train_and_eval(train: DataFrame, held: DataFrame | None = None, size: int = 0, key: str = "id", seed: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """Rows to train and to evaluate on: a table of its own if there is one, else ``size`` rows of the training table by their shuffled order, else none."""
    if held is not None or size <= 0:
        return train, held
    if train.limit(size + 1).count() <= size:
        raise ValueError(f"{size} rows for evaluation must be fewer than there are")
    parts = ranges(train, key, seed, eval=size)
    return parts.filter("split = 'train'").drop("split"), parts.filter("split = 'eval'").drop("split")


#: What a sensor reports: at a time, a component's watts, or the state of its energy counter in millionths of a joule.
SENSORS = "at timestamp, component string, watts double, microjoules double"


def sensors(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Readings of sensors from CSV files with a header, as a table or as they come."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(SENSORS).option("header", True).csv(folder)


def as_column(value: object) -> Column:
    """A column as it is, or one value for every row: arguments that are given once or row by row."""
    if isinstance(value, Column):
        return value
    return F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value)
