"""Every registered query against DuckDB on the smallest tables: columns, types and values."""

import duckdb
import pytest

from gradeloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
#: Queries that take a fixed number of rows, more than the smallest tables have.
LARGER = {"stratified_largest_remainder", "source_quota_mix"}


@pytest.fixture(scope="module")
def duck():
    def connection(folder):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return con

    return {f: connection(f) for f in (FOLDER, "/root/testdata/sf0.01")}


def plain(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    folder = "/root/testdata/sf0.01" if name in LARGER else FOLDER
    got = catalogue.QUERIES[name](spark, folder)
    names = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    want = duck[folder].execute(catalogue.ORACLES[name])
    head = [d[0] for d in want.description]
    assert sorted(head) == names
    kinds = dict(got.dtypes)
    assert {c: TYPES[kinds[c]] for c in names} == {d[0]: str(d[1]) for d in want.description}
    assert rows == sorted(tuple(plain(r[head.index(c)]) for c in names) for r in want.fetchall())


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
