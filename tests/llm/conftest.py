import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, digest string, score double, label string, rest string, gid long, spans string, doc long, th long, a long, b long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "d", 0.5, "x", "r", 2, "s", 3, 4, 5, 6) for i, t in rows], SCHEMA)


WORDS = [f"w{i * 7919 % 1009}x{i}" for i in range(400)]
LONG = " ".join(WORDS[:200])

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "Hello World, again and again. " * 4000), (6, LONG), (7, LONG), (8, LONG + " changed"),
    (None, "a text without an id, of some words"), (9, "é ß 日本語 ✓ odd\n\nlines▁here"), (10, "two words"), (11, "Two  words"), (12, LONG), (13, "x" * 3000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties and near copies, with extra columns of clashing names."""
    return frame(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}
