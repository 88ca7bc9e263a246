"""Readers, writers and the stream."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.sources import readers, writers
from gradeloom.streaming import events

ITEM = T.StructType([T.StructField("id", T.LongType()), T.StructField("question", T.StringType())])


def put(path, text):
    path.write_text(text)
    return str(path)


def test_json_lines(spark, tmp_path):
    path = put(tmp_path / "a.jsonl", '{"id": 1, "question": "é"}\n\n{"id": 2}\n')
    assert [(r.id, r.question) for r in readers.jsonl_strict(spark, path, ITEM).collect()] == [(1, "é"), (2, None)]
    assert readers.jsonl_strict(spark, path, ITEM, limit=1).count() == 1
    assert readers.any_table(spark, path, ITEM).count() == 2
    with pytest.raises(readers.BadRows):
        readers.jsonl_strict(spark, put(tmp_path / "b.jsonl", '{"id": 1}\n[1]\n'), ITEM)


@pytest.mark.parametrize("text", ['[{"id": 1}, {"id": 2}]', '{"data": [{"id": 1}, {"id": 2}]}', '{"rows": [{"id": 1}, {"id": 2}]}', '\n {"examples": [{"id": 1}, {"id": 2}]}'])
def test_json_documents(spark, tmp_path, text):
    assert sorted(r.id for r in readers.any_table(spark, put(tmp_path / "d.json", text), ITEM).collect()) == [1, 2]


def test_csv(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'id,question\n1,"two\nlines, ""quoted"""\n')
    assert readers.csv(spark, path, "id long, question string").first().question == 'two\nlines, "quoted"'
    assert readers.csv(spark, str(tmp_path / "none.csv"), "id long").count() == 0


def test_prediction_files(spark, tmp_path):
    put(tmp_path / "x.csv", "id,response\n")
    assert readers.prediction_file(spark, str(tmp_path)).endswith("x.csv")
    put(tmp_path / "y.jsonl", "{}")
    assert readers.prediction_file(spark, str(tmp_path)).endswith("y.jsonl")
    put(tmp_path / "submission.csv", "id,response\n")
    assert readers.prediction_file(spark, str(tmp_path)).endswith("submission.csv")
    os.makedirs(tmp_path / "empty")
    with pytest.raises(FileNotFoundError):
        readers.prediction_file(spark, str(tmp_path / "empty"))


def test_row_store(spark, tmp_path):
    for i in (1, 2):
        put(tmp_path / f"{i}.json", json.dumps({"id": i, "question": "q"}, indent=1))
    assert readers.row_store(spark, str(tmp_path), ITEM).count() == 2
    put(tmp_path / "3.json", '{"id": 1}')
    with pytest.raises(readers.BadRows):
        readers.row_store(spark, str(tmp_path), ITEM)


def test_newest_checkpoint(spark, tmp_path):
    for i in (9, 10, 100):
        os.makedirs(tmp_path / f"checkpoint-{i}")
        put(tmp_path / f"checkpoint-{i}" / "trainer_state.json", json.dumps({"id": i}))
    assert readers.newest_checkpoint(spark, str(tmp_path), ITEM).first().id == 100


def test_positions_and_hints(spark, tmp_path):
    spark.createDataFrame([("short", 1), ("long enough to be kept here", 2)], "Question string, n long").coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = readers.with_position(spark, str(tmp_path / "p"))
    assert [r.source_row for r in rows.orderBy("source_row").collect()] == [0, 1]
    assert readers.text_columns(rows, ("question",)).count() == 1


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b"), (2, 'c "d"'), (3, "e")], "id long, response string")
    order = spark.createDataFrame([(3, 0), (1, 1)], "id long, position long")
    writers.submission(rows, order, str(tmp_path / "s"))
    assert [r.id for r in readers.csv(spark, str(tmp_path / "s"), "id long, response string").collect()] == [3, 1]
    with pytest.raises(ValueError):
        writers.submission(rows, order.unionByName(spark.createDataFrame([(9, 2)], "id long, position long")), str(tmp_path / "t"))
    writers.append(rows, str(tmp_path / "ledger"))
    writers.append(rows, str(tmp_path / "ledger"))
    assert readers.csv(spark, str(tmp_path / "ledger"), "id long, response string").count() == 6
    writers.parts(rows.withColumn("part", F.col("id") % 2), str(tmp_path / "parts"))
    assert len(readers.files(spark, str(tmp_path / "parts"), "part=*")) == 2
    assert json.loads(writers.manifest(rows.agg(F.count("*").alias("rows")))) == {"rows": 3}
    numbers = spark.createDataFrame([(1.0 / 3,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in numbers.select(writers.figure(F.col("x"))).collect()] == ["0.33333333", "", ""]


def test_unions(spark):
    a, b = spark.createDataFrame([(1, "x")], "id long, v string"), spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, w double")
    assert sorted((r.id, r.v, r.w) for r in readers.by_precedence("id", a, b).collect()) == [(1, "x", None), (2, None, 3.0)]


def test_stream_equals_batch(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    query = events.write_windows(events.stream(spark, str(tmp_path / "in")), "6 hours", "40 days", str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    closed = spark.read.schema("window_start timestamp, event_type string, n long, total double").parquet(str(tmp_path / "out"))
    batch = {(r.window_start, r.event_type): r.n for r in events.tumbling(table.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours").collect()}
    assert all(batch[r.window_start, r.event_type] == r.n for r in closed.collect())
    query = events.write_windows(events.stream(spark, str(tmp_path / "in"), 1), "6 hours", "1 minute", str(tmp_path / "out2"), str(tmp_path / "state2"))
    query.awaitTermination(120)
    got = spark.read.schema(closed.schema).parquet(str(tmp_path / "out2")).collect()
    assert got and all(batch[r.window_start, r.event_type] >= r.n for r in got)


def test_fan_in_leaves_out_what_can_t_be_read(spark, tmp_path):
    from pyspark.sql import types as T

    from gradeloom.sources import readers

    kinds = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    rows = spark.createDataFrame([(1, "a"), (2, "b")], kinds)
    rows.write.json(str(tmp_path / "a.jsonl"))
    rows.write.parquet(str(tmp_path / "b.parquet"))
    with pytest.warns(UserWarning):
        got, skipped = readers.fan_in(spark, [str(tmp_path / n) for n in ("a.jsonl", "b.parquet", "c.parquet", "d.txt")], kinds)
    assert got.count() == 4 and {p.rsplit("/", 1)[-1] for p in skipped} == {"c.parquet", "d.txt"}
    assert readers.fan_in(spark, [str(tmp_path / "a.jsonl")], kinds, 1)[0].count() == 1


def test_train_and_eval(spark):
    from gradeloom.sources import readers

    rows = spark.range(50)
    train, held = readers.train_and_eval(rows, size=10, seed=3)
    assert (train.count(), held.count(), train.join(held, "id").count()) == (40, 10, 0)
    assert readers.train_and_eval(rows)[1] is None and readers.train_and_eval(rows, rows)[1] is rows
    with pytest.raises(ValueError):
        readers.train_and_eval(rows, size=50)


def test_tensors(spark, tmp_path):
    import json

    import numpy as np

    from gradeloom.sources import readers

    a, b = np.arange(6, dtype="<f4"), np.array([1.5, -2.0], "<f4")
    bf = (b.view(np.uint32) >> 16).astype("<u2")
    head = json.dumps({"__metadata__": {}, "a": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "b": {"dtype": "BF16", "shape": [2], "data_offsets": [24, 28]}, "c": {"dtype": "F8", "shape": [0], "data_offsets": [28, 28]}}).encode()
    (tmp_path / "t.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + a.tobytes() + bf.tobytes())
    got = {(r.key, r.part): (r.numbers, r.shape) for r in readers.tensors(spark, str(tmp_path), 4).collect()}
    assert got == {("a", 0): ([0.0, 1.0, 2.0, 3.0], [2, 3]), ("a", 1): ([4.0, 5.0], [2, 3]), ("b", 0): ([1.5, -2.0], [2]), ("c", 0): (None, [0])}


def test_sensors_columns_and_copies(spark, tmp_path):
    from gradeloom.sources import readers, writers

    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.csv").write_text("at,component,watts,microjoules\n2024-01-01 00:00:00,gpu,5.5,\n")
    assert readers.sensors(spark, str(tmp_path / "s")).first().watts == 5.5 and readers.sensors(spark, str(tmp_path / "s"), stream=True).isStreaming
    assert spark.range(1).select(readers.as_column(3).alias("a"), readers.as_column([1, 2]).alias("b"), readers.as_column(F.col("id")).alias("c")).first() == (3, [1, 2], 0)
    writers.copied(spark, "/root/testdata/sf0.001/nation.parquet", str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 25
