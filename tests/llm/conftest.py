import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_fixtures import sentence  # noqa: E402

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.LongType()), T.StructField("key", T.StringType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with further columns whose names clash with inner ones."""

    def made(rows):
        full = [(i, t, *((*more, "en", "s1")[:2] if len(more) < 2 else more[:2]), len(t or ""), 7, "x") for i, t, *more in rows]
        return spark.createDataFrame(full, DOCS)

    return made


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long and repeated texts; null and repeated ids."""
    import random

    rng = random.Random(5)
    base = [sentence(rng, 40) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "   \n\n"), (4, base[0]), (5, base[0]), (5, base[0]), (None, base[1]), (6, base[1] + "\n" + base[2]), (7, " ".join([sentence(rng, 30_000)] * 2)), (8, "\x00 é 😀 a"), (9, base[2].upper()), (10, "x " * 300)]
    return rows
