"""Awkward documents that every text operator and pipeline stage must take."""

import pytest

LONG = "alpha beta gamma delta " * 20_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here.", "en"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here.", None),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here.", None),  # a repeated row
    (3, None, "en"),
    (4, "", None),
    (None, "a text without an id", "de"),
    (None, None, None),
    (5, " \t\n ", "en"),
    (6, LONG, "fr"),
    (7, "Ünïcödé  wörds and spaces 你好 😀 end", "xx"),
    (8, "one", None),
    (9, "one", None),  # a tie
    (10, "x" * 70_000, None),
]
CLASHING = "rid digest first n key ids th fp text_hash score y khash pos lo hi part place base local copies texts root component_id _id _hash keep_id starts ends items tie value".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(df, *columns):
    """Rows as sorted tuples, whatever their order and nulls."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
