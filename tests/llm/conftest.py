import pytest

# Texts that every operator must stand: null, empty, blank, short, long, repeated, clashing marks.
LONG = " ".join(f"word{i % 977} and the" for i in range(9000))
ROWS = [
    (1, "The cat sat on the mat and the dog lay by the door of the old house in the sun all day", "a", "en"),
    (1, "The cat sat on the mat and the dog lay by the door of the old house in the sun all day", "a", "en"),
    (2, None, "a", None), (3, "", None, "en"), (4, " \t\n ", "b", "en"), (5, "one", "b", "en"), (6, "one", "b", "de"),
    (None, "a row without an id but with some words in it", "c", "fr"), (7, LONG, "c", "en"), (8, LONG + " end", None, "en"),
    (9, "é" * 300 + " ü", "a", "fr"), (10, "x " * 400, "a", "en"),
]
CLASHES = "n_words long, shard int, slot int, score double, _key int, _rec int, _text string, _row long, size int, kept string, `odd.name` int"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The same rows with columns named like the operators' own."""
    return docs.selectExpr("*", *[f"CAST(77 AS {t.split()[-1]}) AS {t.split()[0]}" for t in CLASHES.split(", ")])


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
