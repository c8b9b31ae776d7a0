import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = "word " * 30_000 + "x" * 60_000


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with names that operators use."""
    rows = [
        (1, "plain text of a few words", "en", "a"), (1, "plain text of a few words", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, LONG, "de", "b"),
        (5, " \n\t ", "fr", None), (6, "plain text of a few words", "en", "b"), (None, "no id here, mail x@y.org now", "en", "a"), (8, "Über straße 12 <|endoftext|>\x1c   é", "de", "c"), (9, "one", None, "a"),
        (10, "a@b.cc_d@e.ff +1 (017) 555-7713 4111 1111 1111 1111 1.2.3.4 300.1.1.1", "es", "c"),
    ]
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("rep", T.StringType()), ("ids", T.StringType()), ("size", T.LongType()), ("quality", T.StringType()), ("key", T.StringType()), ("pii_spans", T.StringType())]
    return spark.createDataFrame([(*r, len(r[1] or ""), "rep", None, 7, "q", None, "kept") for r in rows], T.StructType([T.StructField(n, t) for n, t in fields])).repartition(3)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
