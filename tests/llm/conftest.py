import pytest
from pyspark.sql import functions as F

from wherewords.session import stage

HOT = "the same opening words of a passage that many documents hold in common with each other again and again until the end of the line"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with
    the names that operators use themselves."""
    rows = [
        (1, None, "en"), (2, "", None), (3, "  \t\n ", "en"), (4, "One two", "en"), (5, "one two ", "de"),
        (6, "a b c d e f", "en"), (6, "a b c d e f", "en"), (None, "A b c d e f", "en"), (None, None, None),
        (7, HOT + "\n" + "x" * 5000, "en"), (8, HOT + "\nother line here", "fr"), (9, HOT + "\nthird line here", "fr"),
        (10, " ".join(f"w{i}" for i in range(3000)), "en"), (11, " ".join(f"w{i}" for i in range(3000)), "en"),
        (12, "¿Qué? ÉCOLE é日本 \u00a0x\u2003y", "es"), (13, "a\0b c, d. e.. f", "en"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    extra = {name: F.lit(1) for name in ("row", "key", "n", "score", "node", "words", "dropped", "comp", "label", "part")}
    return stage(frame.withColumns(extra), "odd-docs")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return stage(odd_docs.limit(0), "no-docs")
