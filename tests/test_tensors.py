"""Tensor files by ranges."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.sources import readers
from gradeloom.sources import tensors as S

KINDS = "key string, kind string, shape array<bigint>, numbers array<double>"


def file_of(path, **tensors):
    head, raw = {"__metadata__": {"by": "test"}}, b""
    for key, (kind, x) in tensors.items():
        head[key] = {"dtype": kind, "shape": list(x.shape), "data_offsets": [len(raw), len(raw) + x.nbytes]}
        raw += x.tobytes()
    text = json.dumps(head).encode()
    path.write_bytes(len(text).to_bytes(8, "little") + text + raw)


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    x = np.arange(10_007, dtype="<f4").reshape(10_007, 1)
    file_of(tmp_path / "a.safetensors", a=("F32", x), b=("I16", np.array([-3, 7], "<i2")), c=("F8", np.zeros(3, "u1")))
    got = readers.tensors(spark, str(tmp_path), 100, 4_000).withColumn("task", F.spark_partition_id())
    rows = got.collect()
    assert len({r.task for r in rows}) == 11 + 2  # ten ranges of 1,000 numbers, one of 7, and the two small tensors
    assert max(len(r.numbers) for r in rows if r.key == "a") == 100
    assert np.concatenate([r.numbers for r in sorted(rows, key=lambda r: r.part) if r.key == "a"]).tolist() == x.ravel().tolist()
    assert [(r.numbers, r.shape) for r in rows if r.key == "b"] == [([-3.0, 7.0], [2])] and [r.numbers for r in rows if r.key == "c"] == [None]


def test_a_file_above_two_gigabytes(tmp_path):
    """Only its header is read to deal it out; the file is sparse."""
    n = 3 << 28
    text = json.dumps({"x": {"dtype": "F32", "shape": [n], "data_offsets": [0, 4 * n]}}).encode()
    with open(tmp_path / "x.safetensors", "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        f.truncate(8 + len(text) + 4 * n)
        f.seek(8 + len(text) + 4 * (n - 2))
        f.write(np.array([1.5, -2.5], "<f4").tobytes())
    size = (tmp_path / "x.safetensors").stat().st_size
    assert size > 2 << 30
    dealt = S.shares([(str(tmp_path / "x.safetensors"), size)], 1 << 20, 64 << 20)
    assert len(dealt) == 48 and sum(last - first for s in dealt for _, _, first, last in s.ranges) == 768
    last = list(S.Reader(str(tmp_path), 1 << 20, 64 << 20).read(S.Share([], [(*dealt[-1].ranges[0][:2], 767, 768)])))
    assert last[0].column("part").to_pylist() == [767] and last[0].column("numbers")[0].as_py()[-2:] == [1.5, -2.5]


def test_written_and_read(spark, tmp_path):
    rows = [(f"k{i}", kind, None if i % 2 else [2, 3], [float(i), -1.0, 0.5, 2.0, 3.0, 4.0]) for i, kind in enumerate(["F64", "F32", "F16", "BF16", "F64", "F32"] * 4)]
    rows += [("i", "I64", [2], [1.0, -2.0]), ("none", "F32", [0], []), ("k0", "F64", None, [9.0])]
    S.write_tensors(spark.createDataFrame(rows, KINDS).repartition(3), str(tmp_path / "t"), 100)
    got = readers.tensors(spark, str(tmp_path / "t")).collect()
    assert sorted((r.key, r.kind, r.shape, r.numbers) for r in got) == sorted((k, d, s or [len(x)], x) for k, d, s, x in rows)
    assert not list((tmp_path / "t").glob("_*"))
    S.write_tensors(spark.createDataFrame([("new", "F32", None, [1.0])], KINDS), str(tmp_path / "t"), mode="overwrite")
    assert [r.key for r in readers.tensors(spark, str(tmp_path / "t")).collect()] == ["new"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([(f"k{i}", "F32", [2] if i == 7 else None, [1.0]) for i in range(10)], KINDS).repartition(4)
    with pytest.raises(Exception, match="shape"):
        S.write_tensors(bad, str(tmp_path / "t"), 4)
    assert not [p for p in (tmp_path / "t").glob("*") if not p.name.startswith("_")]


@pytest.mark.parametrize("content", [b"", b"short", (5).to_bytes(8, "little") + b"{", (2).to_bytes(8, "little") + b"[]", (90).to_bytes(8, "little") + b"{}"])
def test_broken_files_are_named(spark, tmp_path, content):
    (tmp_path / "bad.safetensors").write_bytes(content)
    with pytest.raises(Exception, match="bad.safetensors"):
        readers.tensors(spark, str(tmp_path)).collect()
