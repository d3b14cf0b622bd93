SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

import pytest

# a session fixture named ``spark`` comes from tests/conftest.py

# rows every text operator has to take: nulls, empty and blank texts, ties,
# repeated rows, and columns whose names clash with internal or output names
EDGE = [
    (1, "alpha beta gamma", "en"), (2, None, "en"), (3, "", None), (4, " \t\n", "en"),
    (5, "alpha  beta\tgamma", "en"), (6, "alpha beta gamma", "en"), (6, "alpha beta gamma", "en"),
    (7, "x", None), (8, "x" * 60_000, "en"), (9, "long word " * 9_000, "en"),
]


@pytest.fixture()
def edge_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string")
    for clash in ("source", "slot", "digest", "keep_id", "kept", "score", "fp", "n_words", "_digest", "n", "_w", "_llr"):
        df = df.withColumn(clash, F.lit("clash"))
    return df.withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture()
def no_docs(edge_docs):
    return edge_docs.limit(0)
