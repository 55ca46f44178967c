"""A corpus from documents: each stage works on all that the one before kept.

Rows are told apart by (doc_id, hash of the text), so rows that share a doc_id are judged one by one; of rows that repeat
both, exact dedup keeps one. Stages that filter keep all columns, those with clashing names too.

Defined results, in every stage: a null text counts as empty, and stays null in what is kept; null doc_ids are kept and judged
like others, and sort last where the smallest id stays; very long texts are judged whole; ties and repeated rows get equal
decisions, but for the one copy that a dedup keeps; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.llm import decontaminate as leaks
from swathkit.llm import exact_dedup as exact
from swathkit.llm import packing, simhash
from swathkit.llm import quality as pu
from swathkit.llm.common import Scope, drop, fresh_names, prepare, table, written
from swathkit.llm.common import without as rows_without
from swathkit.llm.tokens import vocabulary


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows (doc_id, text_hash) of dropped; only rows that a filter of dropped may have are shuffled."""
    of_id, of_hash = fresh_names(docs, "dropped_id", "dropped_hash")
    gone = written(dropped.select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash)).distinct(), "dropped")
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    key = lambda doc, text: F.xxhash64(F.coalesce(F.col(doc), F.lit(-1).cast("long")), text)
    same = lambda g: F.col("doc_id").eqNullSafe(F.col(of_id)) & (own == F.col(of_hash))
    return rows_without(docs, key("doc_id", own), gone, key(of_id, F.col(of_hash)), same)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below its threshold) go."""
    model = pu.train(pu.featured(docs), table(spark, sf_dir, "labels"))
    return docs.filter(pu.score_column(F.col("text"), model) >= pu.THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays; of rows that share it too, any one."""
    found = written(exact.exact_dedup(docs, text_hash=True).filter("not kept"), "not-kept")
    repeats = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = without(docs, found.filter(~repeats))
    if found.filter(repeats).isEmpty():
        return out
    (digest,) = fresh_names(docs, "text_digest")
    return out.withColumn(digest, exact.text_digest(F.col("text"))).dropDuplicates(["doc_id", digest]).drop(digest)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays."""
    found = simhash.near_duplicates(docs, text_hash=True)
    return without(docs, found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words of a benchmark window go."""
    prepare(spark)
    return docs.filter(~leaks.contaminated_column(F.col("text"), spark, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("decontaminate", decontaminate), ("packing", pack)]
#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread; only the last one's input and tables outlive it."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with Scope(spark, name) as scope:
            out = stage(spark, docs, sf_dir)
        docs = written(out, f"stage-{name}")
        scope.delete()  # what the stage wrote on its way, and the stage before
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
