import random

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of ``(doc_id, text)`` with further columns that clash with names the operators use."""

    def make(rows):
        fields = "doc_id:bigint,text:string,kept:string,h:int,ids:string,row_no:string,u:string,component_id:string"
        schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in (f.split(":") for f in fields.split(","))])
        return spark.createDataFrame([(i, t, "x", 1, "y", None, None, "z") for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def prose():
    """Random words; the same seed gives the same text."""

    def make(seed, n, vocabulary=2000):
        r = random.Random(seed)
        words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(1 + k % 4)) + str(k) * (k % 7 == 0) for k in range(vocabulary)]
        return " ".join(r.choice(words) for _ in range(n))

    return make


AWKWARD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (None, "a"), (5, "\x1c\t \n  x  "), (6, "ü😀 e a \n" * 3),
    (7, "same"), (8, "same"), (8, "same"), (None, None), (9, "<|endoftext|> don't  x<|endoftext|>  \n\n y"),
]


@pytest.fixture(scope="session")
def awkward():
    return AWKWARD
