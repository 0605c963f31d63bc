import pytest
from pyspark.sql import functions as F

CLASHES = ("id", "n", "place", "bands", "items", "slot", "copy", "epoch", "lines", "kept", "spans", "seed", "vid", "mid", "gone", "page", "step")
LONG = " ".join(f"long{i % 977}x{i}" for i in range(40_000))
ODD = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "x", "en", "b"), (5, LONG, "en", "b"), (6, "three little words", "en", "a"), (6, "three little words", "en", "a"),
    (7, "日本語 テキスト ▁x  ▁▁y é 🙂\x00", None, None), (8, "same line of words here\n" * 30, "en", "a"), (9, "same line of words here\n" * 30, "en", "b"), (None, "a text without an id, of eight words", "en", "a"), (10, "password = hunter2hunter2", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators use."""
    rows = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({c: F.lit("extra") for c in CLASHES})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
