"""Rows that every operator must take: nulls, empty and long texts, copies, clashing columns."""

import pytest
from pyspark.sql import types as T

#: Extra columns with the names that operators use inside.
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.StringType()) for n in ("id", "row", "key", "fp", "score", "n"))])


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def odd_rows():
    passage = " ".join(f"shared{i} word" for i in range(40))
    long = " ".join(f"w{i * 7919 % 5000}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one two"), (6, "Ä ß 中文 😀   end"), (7, long), (8, long), (8, long),
        (None, "a null id with some words"), (None, None), (9, "a null id with some words"), (9, "another text of the same id"), (10, "x" * 3000),
        (11, f"before it {passage} after it"), (12, f"other {passage} words"), (13, "Same  Words\nhere"), (14, "Same Words here"), (15, "same words here"), (16, "<|endoftext|> <s> ▁ "),
        (17, "tick tock " * 400),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return docs(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return docs(spark, [])
