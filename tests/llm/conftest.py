import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = "longword " * 40_000 + "x" * 20_000
    rows = [
        (1, "You idiot, said no one. The day was long.", "en", "s0", 10),
        (2, "You idiot, said no one. The day was long.", "en", "s0", 10),
        (2, "You idiot, said no one. The day was long.", "en", "s0", 10),
        (3, None, None, None, None),
        (4, "", "", "", 0),
        (5, "   \n\t ", "en", "s1", 5),
        (6, long, "en", "s1", len(long)),
        (None, "a row without an id", "en", None, 1),
        (None, None, None, None, None),
        (7, "één ünïcode \U0001f600 text", "fr", "s2", 3),
        (8, "one", "en", "s2", 3),
    ]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, DOCS)
    clashing = ("fp", "rep", "key", "score", "label", "word", "bin", "shard", "range", "k", "text_", "at", "row", "component_id", "__id")
    return docs.withColumns({c: F.lit(1) for c in clashing})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
