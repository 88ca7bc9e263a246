import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, __row string, s string, at string, shard string, g string"


def documents(spark, rows):
    """Documents with columns whose names operators use for themselves; rows: doc_id, text, lang, source."""
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else 0, "x", "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA)


LONG = "wörd tail\n" * 40_000
EDGES = [
    (1, "One two three four five six seven.", "en", "a"),
    (2, "One two three four five six seven.", "en", "a"),
    (2, "One two three four five six seven.", "en", "a"),
    (3, None, None, None),
    (4, "", "en", None),
    (5, "   \n\t", "de", "b"),
    (None, "no id here at all, none", "en", "b"),
    (None, None, None, "b"),
    (7, LONG, "de", "c"),
    (8, "x" * 200_000, "fr", "c"),
    (9, "12345 67890 !!!", "fr", "c"),
    (10, "émile ﬁn ÀÉ", "fr", "c"),
    (11, "a", "es", "d"),
]


@pytest.fixture(scope="session")
def edge_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges") / "documents")
    documents(spark, EDGES).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return documents(spark, []).filter("doc_id IS NOT NULL")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
