"""Exact dedup against a dictionary of texts."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from swathkit.llm.exact_dedup import DigestIndex, exact_dedup, op4_exact_dedup
from tests.llm.conftest import TEXTS, rows_of

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def brute(docs):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in docs]
    groups = defaultdict(list)
    for d, t in norm:
        groups[t].append(d)
    out = []
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda x: (x is None, x or 0))
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(d, ids[0], len(ids), k == 0, sha) for k, d in enumerate(ids)]
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, sf_dir, documents):
    assert rows_of(op4_exact_dedup(spark, sf_dir), *COLUMNS) == brute(documents)


def test_odd_documents(odd_docs, no_docs):
    assert rows_of(exact_dedup(odd_docs), *COLUMNS) == brute([(d, t) for d, t, _ in TEXTS])
    assert exact_dedup(no_docs).count() == 0 and exact_dedup(no_docs).columns[:5] == COLUMNS


def test_the_query_compacts_and_asks_filters(odd_docs, documents, spark, sf_dir):
    """op4 itself flushes several runs and compacts; more runs change nothing."""
    index = DigestIndex(spark)
    assert rows_of(exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), index=index), *COLUMNS) == brute(documents)
    assert index.compactions == 1 and [len(x) for x in index.levels] == [1, 1]
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    assert rows_of(exact_dedup(docs, batches=9), *COLUMNS) == rows_of(exact_dedup(docs, batches=1), *COLUMNS) == brute(documents)
    index = DigestIndex(spark, fanout=2)
    assert rows_of(exact_dedup(odd_docs, batches=7, index=index), *COLUMNS) == brute([(d, t) for d, t, _ in TEXTS])
    assert index.compactions == 4 and [len(x) for x in index.levels] == [1, 1, 1]


def test_runs_keep_the_smallest_identifier(spark):
    index = DigestIndex(spark, fanout=2)
    rows = spark.range(40).select((F.col("id") % 5).cast("string").cast("binary").alias("digest"), F.col("id").alias("doc_id"), F.col("id").alias("rid"))
    once = spark.range(40, 60).select(F.col("id").cast("string").cast("binary").alias("digest"), F.col("id").alias("doc_id"), F.col("id").alias("rid"))
    for k in (4, 2, 0, 3, 1):
        index.append(rows.filter(F.floor(F.col("doc_id") / 5) % 5 == k).unionByName(once.filter(F.col("doc_id") % 5 == k)))
    assert [len(x) for x in index.levels] == [1, 0, 1]  # five runs, two to a level
    assert {(r["first"].doc_id, r.n) for r in index.hits().collect()} == {(k, 8) for k in range(5)}
    assert sum(r.rows.count() for r in index.runs) == 30


def test_colliding_digests_are_told_apart(odd_docs, spark, documents):
    short = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 1)
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    assert rows_of(exact_dedup(docs, digest=short), *COLUMNS) == brute(documents)
    assert rows_of(exact_dedup(odd_docs, digest=lambda t: F.lit(b"same")), *COLUMNS) == brute([(d, t) for d, t, _ in TEXTS])
