"""Ledgers: appends whole or not at all, each once."""

import threading

import pytest
from pyspark.sql import functions as F

from gradeloom.sources import ledgers, readers, writers

KINDS = "n long, name string"


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), KINDS)


def seen(spark, path, kinds=KINDS):
    return sorted((tuple(r) for r in readers.csv(spark, path, kinds).collect()), key=str)


def test_three_appends_are_read_whole(spark, tmp_path):
    path, want = str(tmp_path / "ledger"), []
    assert seen(spark, path) == []
    for i in range(3):
        own = [(3 * i + j, f'run, "{i}"\n{j}') for j in range(3)]
        assert writers.append(rows_of(spark, *own), path)
        want += own
        assert seen(spark, path) == sorted(want, key=str)
    assert [e["rows"] for e in ledgers.entries(spark, path)] == [3, 3, 3]
    assert ledgers.append(spark.range(40).repartition(4).select(F.col("id").alias("n"), F.lit("x").alias("name")), path)
    assert len(seen(spark, path)) == 49


def test_a_killed_append_is_never_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    ledgers.append(rows_of(spark, (1, "a")), path)

    def killed(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(ledgers, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        ledgers.append(rows_of(spark, (2, "b"), (3, "c")), path, "again")
    monkeypatch.undo()
    assert seen(spark, path) == [(1, "a")]
    fails = rows_of(spark, (4, "d")).withColumn("n", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        ledgers.append(fails, path)
    assert seen(spark, path) == [(1, "a")]
    assert ledgers.append(rows_of(spark, (2, "b"), (3, "c")), path, "again") and not ledgers.append(rows_of(spark, (2, "b"), (3, "c")), path, "again")
    assert seen(spark, path) == [(1, "a"), (2, "b"), (3, "c")]
    assert ledgers.swept(spark, path, 3_600) == 0
    assert ledgers.swept(spark, path, -5) == 2 and len(seen(spark, path)) == 3


def test_appends_at_one_time(spark, tmp_path):
    path = str(tmp_path / "ledger")
    threads = [threading.Thread(target=ledgers.append, args=(rows_of(spark, (i, "t")), path)) for i in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [r[0] for r in seen(spark, path)] == list(range(5))


def test_columns_by_name(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledgers.append(rows_of(spark, (1, "a"), (2, None), (3, "")), path)
    ledgers.append(spark.createDataFrame([("b", 4, 2.5)], "name string, n long, more double"), path)
    assert seen(spark, path) == sorted([(1, "a"), (2, None), (3, None), (4, "b")], key=str)
    assert seen(spark, path, "more double, n long") == sorted([(None, 1), (None, 2), (None, 3), (2.5, 4)], key=str)
    assert ledgers.append(rows_of(spark, (5, "z")).filter("n > 9"), path) and len(seen(spark, path)) == 4


def test_what_is_wrong_is_said(spark, tmp_path):
    path = tmp_path / "ledger"
    ledgers.append(rows_of(spark, (1, "a")), str(path), "one")
    with pytest.raises(ValueError, match="batch"):
        ledgers.append(rows_of(spark, (1, "a")), str(path), "../up")
    next((path / ledgers.ROWS).glob("one-*")).rename(tmp_path / "gone")
    with pytest.raises(ledgers.BadLedger):
        readers.csv(spark, str(path), KINDS)
    (path / ledgers.MANIFEST / "two.json").write_text("{")
    with pytest.raises(ledgers.BadLedger):
        ledgers.entries(spark, str(path))
