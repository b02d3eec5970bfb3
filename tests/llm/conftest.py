"""Shared fixtures: the driver's tables and a table of awkward rows."""

import pytest
from pyspark.sql import functions as F

SMOKE = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SMOKE}/{name}.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Null, empty, blank, tiny, very long, repeated and copied texts, a null id, and columns with clashing names."""
    long = " ".join(f"word{i} of a very long text." for i in range(30_000))
    plain = "A plain sentence that says something useful about the weather in spring today.\nAnother line follows here, with words of its own."
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "tiny"), (5, long), (6, plain), (6, plain), (7, plain), (8, plain + " Truly."), (None, plain),
        (9, "one | two | three | four | five | six | seven | eight | nine | ten | eleven | twelve"), (10, "x" * 100_000), (-5, "same same " * 200), (2**62, "ünï ćödé 😀 " * 30),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ["kept", "n_words", "words", "class_id", "id", "n", "a", "band", "length", "piece", "shard", "slot", "fp", "html", "host"]
    return df.withColumns({c: F.lit(7) for c in clash} | {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
