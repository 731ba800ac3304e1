import pytest

from tests.conftest import DATA


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


#: Rows that any operator on documents must take: nulls, empty and long texts, repeated rows, ties, and columns with names that operators use inside.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three four five six seven eight nine ten " * 30), (5, "one two three four five six seven eight nine ten " * 30),
    (6, "Mail me: a.b@c-d.example.org, +1 (555) 010-9999 or 10.0.0.1 and 4111 1111 1111 1111."), (7, "wörter ñandú 東京 ½ …  x " * 40), (None, "no id at all"), (8, "x" * 30000), (9, "word " * 20000),
]
CLASHING = "doc_id long, text string, id long, fp string, hash string, size string, shard string, slot string, item string, label string, key string, tag string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, *["c"] * 0, 1, "a", "b", "c", "d", "e", "f", "g", "h", "i") for i, t in ODD], CLASHING)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], CLASHING)
