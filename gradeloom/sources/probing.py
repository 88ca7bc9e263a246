"""Files are looked at before they are read: what each one is by its first bytes, and why some can't be read.

Tasks probe files, several to a task, through Arrow's file systems. Only heads, ends and, of JSON, lines are read, a piece at a time; a JSON document has to be held whole,
so one over ``most`` bytes is turned down, as are empty files. What is found is a table; readers take what is sound, so a broken file neither stops an action nor goes unseen.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tensors import opened

#: The largest JSON document that is read.
MOST = 250_000_000
PROBED = "path string, kind string, bytes long, rows long, bad_rows long, reason string"
_GAP = b" \t\r\n\xef\xbb\xbf"


def kind_of(head: bytes, name: str) -> str:
    """parquet, array or object (a JSON document), lines (of JSON), csv, or other."""
    if head[:4] == b"PAR1" or name.endswith(".parquet"):
        return "parquet"
    first = head.lstrip(_GAP)[:1]
    if first == b"[":
        return "array"
    if name.endswith(".csv"):
        return "csv"
    if first == b"{" and name.endswith(".json"):
        line = head.lstrip(_GAP).split(b"\n", 1)[0]
        try:
            return "lines" if isinstance(json.loads(line), dict) and b"\n" in head.strip() else "object"
        except ValueError:
            return "object"
    return "lines" if first == b"{" or name.endswith(".jsonl") else "other"


def lines_of(file, piece: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while part := file.read(piece):
        whole, _, end = (rest + part).rpartition(b"\n")
        yield from whole.split(b"\n") if whole else ()
        rest = end
    if rest:
        yield rest


def probed(path: str, most: int = MOST) -> dict[str, object]:
    """One file: its kind, size, rows (those of JSON that aren't objects are bad), and why it can't be read, or null."""
    out: dict[str, object] = {"path": path, "kind": "other", "bytes": None, "rows": None, "bad_rows": 0, "reason": None}
    try:
        system, inner = opened(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            return out | {"reason": "not found"}
        out["bytes"] = info.size
        if not info.size:
            return out | {"reason": "empty"}
        with system.open_input_file(inner) as f:
            out["kind"] = kind_of(f.read_at(min(info.size, 1 << 16), 0), path.rsplit("/", 1)[-1])
            f.seek(0)
            if out["kind"] == "parquet":
                out["rows"] = pq.ParquetFile(f).metadata.num_rows
            elif out["kind"] in ("array", "object"):
                if info.size > most:
                    return out | {"reason": f"a JSON document over {most} bytes"}
                whole = json.loads(f.read())
                rows = whole if isinstance(whole, list) else next((whole[k] for k in ("data", "rows", "examples") if isinstance(whole.get(k), list)), [whole])
                out |= {"rows": len(rows), "bad_rows": sum(not isinstance(r, dict) for r in rows)}
            elif out["kind"] == "lines":
                n = bad = 0
                for line in lines_of(f):
                    if line.strip(_GAP):
                        n += 1
                        try:
                            bad += not isinstance(json.loads(line), dict)
                        except ValueError:
                            bad += 1
                out |= {"rows": n, "bad_rows": bad, "reason": "no row is a JSON object" if n and bad == n else None}
    except (ValueError, OSError, pa.ArrowException, RecursionError) as error:
        out["reason"] = f"{type(error).__name__}: {str(error).splitlines()[0][:200] if str(error) else ''}"
    return out


def probe(spark: SparkSession, paths: list[str], most: int = MOST) -> DataFrame:
    """A row a file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [probed(p, most) for p in b.column(0).to_pylist()]
            names = [("path", pa.string()), ("kind", pa.string()), ("bytes", pa.int64()), ("rows", pa.int64()), ("bad_rows", pa.int64()), ("reason", pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], k) for n, k in names], [n for n, _ in names])

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4))).mapInArrow(rows, PROBED)


def objects(spark: SparkSession, found: DataFrame, schema) -> DataFrame:
    """The JSON objects of sound files, lines and documents alike, with ``source_file``; rows that are no object of the schema are left out."""
    good = found.filter("reason IS NULL").select("path", "kind").collect()  # a row a file
    out = spark.createDataFrame([], schema).withColumn("source_file", F.lit(""))
    lines, documents = ([r.path for r in good if r.kind in kinds] for kinds in (("lines",), ("array", "object")))
    file = F.col("_metadata.file_path").alias("source_file")
    if lines:
        text = spark.read.text(lines).select("value", file)
        parsed = text.filter(F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull())
        out = out.unionByName(parsed.select(F.from_json("value", schema).alias("r"), "source_file").select("r.*", "source_file"))
    if documents:
        whole = spark.read.text(documents, wholetext=True).select("value", file)
        doc = F.try_parse_json("value")
        items = F.coalesce(*(F.try_variant_get(doc, p, "array<variant>") for p in ("$", "$.data", "$.rows", "$.examples")), F.array(doc))
        rows = whole.select(F.explode(items).alias("v"), "source_file").filter(F.to_json("v").startswith("{"))
        out = out.unionByName(rows.select(F.from_json(F.to_json("v"), schema).alias("r"), "source_file").select("r.*", "source_file"))
    return out
