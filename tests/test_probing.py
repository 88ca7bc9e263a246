"""Broken, large and odd files beside sound ones."""

import json

import pytest
from pyspark.sql import types as T

from gradeloom.sources import probing, readers

KINDS = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


def put(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], KINDS).coalesce(1).write.parquet(str(tmp_path / "p"))
    sound = next((tmp_path / "p").glob("part*")).read_bytes()
    files = {
        "a.parquet": sound, "cut.parquet": sound[: len(sound) // 2], "b.json": '[{"id": 3, "text": "c"}, 7, {"id": 4}]', "c.json": '\n {"rows": [{"id": 5}]}', "d.json": '{"id": 6, "text": "é"}\n{"id": 7}\n',
        "e.jsonl": '{"id": 8}\n\nnot json\n[1]\n{"id": 9, "text": "x\\ny"}', "broken.json": '[{"id": 1}, {"id"', "empty.jsonl": "", "none.jsonl": "[1]\n2\n", "big.json": json.dumps([{"id": i} for i in range(500)]), "one.json": '{"id": 10}',
    }
    return {n: put(tmp_path / n, c) for n, c in files.items()} | {"missing.json": str(tmp_path / "missing.json")}


def test_probe(spark, folder):
    found = {r.path.rsplit("/", 1)[-1]: r for r in probing.probe(spark, list(folder.values()), most=3_000).collect()}
    assert {n: r.kind for n, r in found.items() if r.reason is None} == {"a.parquet": "parquet", "b.json": "array", "c.json": "object", "d.json": "lines", "e.jsonl": "lines", "one.json": "object"}
    assert {n: (r.rows, r.bad_rows) for n, r in found.items() if r.reason is None} == {"a.parquet": (2, 0), "b.json": (3, 1), "c.json": (1, 0), "d.json": (2, 0), "e.jsonl": (4, 2), "one.json": (1, 0)}
    reasons = {n: r.reason for n, r in found.items() if r.reason}
    assert set(reasons) == {"cut.parquet", "broken.json", "empty.jsonl", "none.jsonl", "big.json", "missing.json"}
    assert reasons["empty.jsonl"] == "empty" and reasons["missing.json"] == "not found" and "3000 bytes" in reasons["big.json"] and reasons["broken.json"].startswith("JSONDecodeError")


def test_objects_of_sound_files(spark, folder):
    found = probing.probe(spark, [p for n, p in folder.items() if not n.endswith("parquet")], most=3_000)
    got = {(r.id, r.text, r.source_file.rsplit("/", 1)[-1]) for r in probing.objects(spark, found, KINDS).collect()}
    assert got == {(3, "c", "b.json"), (4, None, "b.json"), (5, None, "c.json"), (6, "é", "d.json"), (7, None, "d.json"), (8, None, "e.jsonl"), (9, "x\ny", "e.jsonl"), (10, None, "one.json")}
    assert probing.objects(spark, found.filter("false"), KINDS).count() == 0


def test_fan_in_goes_on_without_broken_files(spark, folder):
    with pytest.warns(UserWarning):
        rows, skipped = readers.fan_in(spark, list(folder.values()), KINDS)
    got = sorted((r.id, r.source_file.rsplit("/", 1)[-1]) for r in rows.collect())  # at the action nothing fails
    assert [g for g in got if g[1] != "big.json"] == [(1, "a.parquet"), (2, "a.parquet"), (3, "b.json"), (4, "b.json"), (5, "c.json"), (6, "d.json"), (7, "d.json"), (8, "e.jsonl"), (9, "e.jsonl"), (10, "one.json")]
    assert {p.rsplit("/", 1)[-1] for p in skipped} == {"cut.parquet", "broken.json", "empty.jsonl", "none.jsonl", "missing.json"}
    assert skipped[folder["cut.parquet"]].startswith("Arrow")
