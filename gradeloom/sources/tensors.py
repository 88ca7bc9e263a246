"""Tensor files (a JSON header behind its length, then numbers) as a data source: ``spark.read.format("tensors")`` and ``df.write.format("tensors")``.

Reading: the driver lists the files, and reads the header of those that are larger than a task's share; their tensors are cut into ranges of whole blocks, and each task
reads its ranges only, so a file of any size is read by many tasks at once. Smaller files are given to tasks by the handful, and a task reads their
headers itself. No task holds more than one block of numbers.

Writing: each task writes files of up to ``file_bytes``; only when all tasks have ended do the files get their names, so a failed write leaves none
that a reader takes, and a task that runs twice leaves none twice.

Files are reached through Arrow's file systems (local ones, HDFS, S3 and others by the path's scheme).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Number formats of tensor files.
NUMBERS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U8": "<u1", "BF16": "<u2"}
TENSOR = "path string, key string, kind string, shape array<bigint>, part bigint, numbers array<double>"
_ARROW = pa.schema([("path", pa.string()), ("key", pa.string()), ("kind", pa.string()), ("shape", pa.list_(pa.int64())), ("part", pa.int64()), ("numbers", pa.list_(pa.float64()))])
SUFFIX, DRAFT = ".safetensors", "_draft-"


class BadTensorFile(ValueError):
    """A file whose header isn't one, or that is shorter than its header says."""


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace(":", "://", 1))
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """Files and their sizes: the path itself, or those in it by name, without hidden ones."""
    files, inner = opened(path)
    info = files.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [f for f in files.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and f.base_name[:1] not in "._" and f.base_name.endswith(SUFFIX)]
    return sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found)


@dataclass
class Tensor:
    key: str
    kind: str
    shape: list[int]
    start: int
    end: int

    def count(self) -> int:
        return (self.end - self.start) // np.dtype(NUMBERS[self.kind]).itemsize if self.kind in NUMBERS else 0


def header(file, size: int, name: str) -> list[Tensor]:
    """The tensors of an open file, in order of their places in it."""
    try:
        length = int.from_bytes(file.read_at(8, 0), "little")
        if not 0 < length <= size - 8:
            raise ValueError("length")
        found = []
        for key, t in json.loads(file.read_at(length, 8)).items():
            if key != "__metadata__":
                start, end = (8 + length + x for x in t["data_offsets"])
                found.append(Tensor(key, t["dtype"], t["shape"], start, end))
                if not 8 + length <= start <= end <= size:
                    raise ValueError(key)
    except (ValueError, KeyError, TypeError, AttributeError) as error:
        raise BadTensorFile(f"{name}: {error}") from error
    return sorted(found, key=lambda t: (t.start, t.key))


@dataclass
class Share(InputPartition):
    """What one task reads: whole files, or blocks from first to before last of a tensor."""

    files: list[tuple[str, int]]
    ranges: list[tuple[str, Tensor, int, int]]


def shares(files: list[tuple[str, int]], block: int, task_bytes: int) -> list[Share]:
    out, small, held = [], [], 0
    for path, size in files:
        if size > task_bytes:
            system, inner = opened(path)
            with system.open_input_file(inner) as f:
                for t in header(f, size, path):
                    blocks = max(1, -(-t.count() // block))
                    step = max(1, task_bytes // (block * np.dtype(NUMBERS.get(t.kind, "<f8")).itemsize))
                    out += [Share([], [(path, t, i, min(blocks, i + step))]) for i in range(0, blocks, step)]
            continue
        if small and held + size > task_bytes:
            out.append(Share(small, []))
            small, held = [], 0
        small.append((path, size))
        held += size
    return [*out, Share(small, [])] if small else out


def numbers(raw: bytes, kind: str) -> np.ndarray:
    x = np.frombuffer(raw, NUMBERS[kind])
    return ((x.astype(np.uint32) << 16).view(np.float32) if kind == "BF16" else x).astype(float)


class Reader(DataSourceReader):
    def __init__(self, path: str, block: int, task_bytes: int) -> None:
        self.path, self.block, self.task_bytes = path, block, task_bytes

    def partitions(self) -> list[Share]:
        return shares(listed(self.path), self.block, self.task_bytes) or [Share([], [])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for path, size in partition.files:
            system, inner = opened(path)
            with system.open_input_file(inner) as f:
                for t in header(f, size, path):
                    yield from self.blocks(f, path, t, 0, max(1, -(-t.count() // self.block)))
        for path, t, first, last in partition.ranges:
            system, inner = opened(path)
            with system.open_input_file(inner) as f:
                yield from self.blocks(f, path, t, first, last)

    def blocks(self, file, path: str, t: Tensor, first: int, last: int) -> Iterator[pa.RecordBatch]:
        wide = np.dtype(NUMBERS.get(t.kind, "<f8")).itemsize
        for part in range(first, last):
            at = t.start + part * self.block * wide
            n = min(self.block * wide, t.end - at)
            values = None if t.kind not in NUMBERS else numbers(file.read_at(n, at), t.kind)
            flat = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values)) if values is not None else pa.nulls(1, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([t.key]), pa.array([t.kind]), pa.array([t.shape], pa.list_(pa.int64())), pa.array([part], pa.int64()), flat], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceWriter):
    """Rows of key, kind, shape and numbers, one whole tensor each."""

    def __init__(self, path: str, file_bytes: int, overwrite: bool) -> None:
        self.path, self.file_bytes, self.overwrite, self.job = path, file_bytes, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, inner = opened(self.path)
        system.create_dir(inner, recursive=True)
        names, held, size, keys = [], [], 0, set()

        def put() -> None:
            head, at = {}, 0
            for key, kind, shape, raw in held:
                head[key] = {"dtype": kind, "shape": shape, "data_offsets": [at, at + len(raw)]}
                at += len(raw)
            text = json.dumps(head).encode()
            name = f"{uuid.uuid4().hex}{SUFFIX}"
            with system.open_output_stream(f"{inner}/{DRAFT}{self.job}-{name}") as f:
                f.write(len(text).to_bytes(8, "little") + text)
                for *_, raw in held:
                    f.write(raw)
            names.append(name)

        for r in rows:
            if r.kind not in NUMBERS or r.numbers is None:
                raise BadTensorFile(f"tensor {r.key}: numbers of kind {r.kind} can't be written")
            values = np.array(r.numbers, float)
            raw = (values.astype("<f4").view("<u4") >> 16).astype("<u2").tobytes() if r.kind == "BF16" else values.astype(NUMBERS[r.kind]).tobytes()
            shape = [len(values)] if r.shape is None else list(r.shape)
            if int(np.prod(shape)) != len(values):
                raise BadTensorFile(f"tensor {r.key}: {len(values)} numbers in the shape {shape}")
            if held and (size + len(raw) > self.file_bytes or r.key in keys):
                put()
                held, size, keys = [], 0, set()
            held.append((r.key, r.kind, shape, raw))
            keys.add(r.key)
            size += len(raw)
        if held:
            put()
        return Written(names)

    def commit(self, messages: list[Written]) -> None:
        system, inner = opened(self.path)
        if self.overwrite:
            for name, _ in listed(self.path) if messages and system.get_file_info(inner).type == fs.FileType.Directory else []:
                system.delete_file(f"{inner}/{name.rsplit('/', 1)[-1]}")
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{inner}/{DRAFT}{self.job}-{name}", f"{inner}/{name}")
        self.clean()

    def abort(self, messages: list[Written]) -> None:
        self.clean()

    def clean(self) -> None:
        """Drafts of this job that aren't wanted: of attempts that failed or came second."""
        system, inner = opened(self.path)
        if system.get_file_info(inner).type == fs.FileType.Directory:
            for f in system.get_file_info(fs.FileSelector(inner)):
                if f.base_name.startswith(f"{DRAFT}{self.job}"):
                    system.delete_file(f.path)


class Tensors(DataSource):
    """Options: path; ``block`` numbers a row, ``task_bytes`` a task (reading); ``file_bytes`` a file (writing)."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return TENSOR

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("block", 1 << 20)), int(self.options.get("task_bytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("file_bytes", 256 << 20)), overwrite)


def tensors(spark: SparkSession, path: str, block: int = 1 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """A row for each ``block`` numbers of each tensor under a path, ``part`` counting from 0. Numbers in a format that isn't known are null."""
    spark.dataSource.register(Tensors)
    return spark.read.format("tensors").option("block", block).option("task_bytes", task_bytes).load(path)


def write_tensors(rows: DataFrame, path: str, file_bytes: int = 256 << 20, mode: str = "append") -> None:
    """key, kind, shape (null: one row of them) and numbers as tensor files."""
    rows.sparkSession.dataSource.register(Tensors)
    rows.select("key", "kind", "shape", "numbers").write.format("tensors").option("file_bytes", file_bytes).mode(mode).save(path)
