"""Rows at the edge, for all text operators."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names are those of results."""
    words = [f"w{i % 977}x{i % 31}" for i in range(30_000)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, "Hello,  World. it's\n<|endoftext|> ok", "a"), (2, None, "a"), (3, "", None), (4, " \n\t ", "b"), (5, " ".join(words), "b"),
        (6, "start " + passage + " end", "b"), (7, "other " + passage, "c"), (7, "other " + passage, "c"), (8, "start " + passage + " end", "a"), (None, "null id " + passage, "a"),
        (9, "ΑΣ É ǅ ́ x\u00a0y\u0085z \0 1234", None), (10, "a b", "a"), (11, "a b", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("start", "length", "n_words", "score", "k", "c0", "whole", "host", "row", "part", "starts"):
        df = df.withColumn(name, F.lit("x"))
    return df
