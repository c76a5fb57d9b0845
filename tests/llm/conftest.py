from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly boil fresh tea near the old mill".split()


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and a clashing column."""
    prose = " ".join(WORDS)
    rows = [
        (1, prose + ".\nA line that several documents share.", "en", "a", 1),
        (2, "A line that several documents share.\n" + prose.replace("fox", "cat") + ".", "en", "a", None),
        (3, prose + ".\nA line that several documents share.", "en", None, 1),
        (3, prose + ".\nA line that several documents share.", "en", None, 1),
        (4, None, "en", "a", 1),
        (5, "", None, "a", 0),
        (6, " \t\n\v\f\r\n\n", "fr", "a", 7),
        (7, "12345 67890 !!!", None, "b", 15),
        (8, " ".join(f"w{i}x" for i in range(30_000)), "de", "b", 1),
        (None, prose, "en", "a", 1),
        (9, "Only four words here", "en", "b", 20),
        (10, "only FOUR words\there", "en", "b", 20),
        (11, "x" * 50_000, "en", "b", 50_000),
        (12, "a  b \n c<|endoftext|>d   e f 's ''s", "en", "b", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {"n_tokens": F.lit("clash"), "kept": F.lit(1), "size": F.lit(2), "key": F.lit(3), "place": F.lit(4)}
    )


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
