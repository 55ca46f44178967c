"""Folds and bounded samples of labels for the classifiers that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathkit.llm.common import documents

SCALE = 1 << 30


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text, modulo folds, is the held-out fold; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def _part(of: Column, share: float) -> Column:
    return F.pmod(F.xxhash64(of, F.lit("sample")), F.lit(SCALE)) < int(min(1.0, share) * SCALE)


def training_labels(labels: DataFrame, label: str, folds: int, fold: int) -> DataFrame:
    """(doc_id, y) of rows that may be learned from; of several labels for an id, the majority, and 1 of a tie."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("y")).dropna()
    return rows.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).filter(~held_out(F.col("doc_id"), folds, fold))


def sample_of_labels(train: DataFrame, most: int) -> DataFrame:
    """At most `most` rows of train, by a hash of the id."""
    n = train.count()
    return train.filter(_part(F.col("doc_id"), 0.95 * most / n if n > most else 1.0)).limit(most)


def with_text(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents of a bounded sample of labels: (doc_id, text, y). The sample is broadcast; its bound is its limit."""
    return documents(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")

