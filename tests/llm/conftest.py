import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that clash with names the operators use inside or return.
CLASHING = ["score", "size", "group_id", "_range", "held_out", "start", "n_tokens", "signature", "target", "h", "key", "__id"]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with clashing extra columns if wanted."""
    from pyspark.sql import functions as F

    def build(rows, clashing=False):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1] or "")) for r in rows]
        docs = spark.createDataFrame(full, SCHEMA)
        return docs.withColumns({c: F.lit("x") for c in CLASHING}) if clashing else docs

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} of{i % 53}" for i in range(60_000))
    return [
        (1, None), (2, ""), (3, long), (4, "the same words in the same order here"), (5, "the same words in the same order here"),
        (5, "the same words in the same order here"), (None, "a text without an id"), (None, None), (7, "!!! ??? ..."), (8, "x"), (9, "éè \U0001f600 z"),
    ]


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
