"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from swathkit.llm import quality
from swathkit.llm.common import written
from swathkit.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import rows_of
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_exact_dedup import brute as copies
from tests.llm.test_simhash import brute as near
from tests.llm.test_simhash import slow_fingerprint
from tests.llm.test_tokens import PACKED, check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "simhash_dedup", "decontaminate", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in P.STAGES[:-1]:
        before, after = pairs(kept), written(stage(spark, kept, sf_dir), f"test-{name}")
        assert after.columns == columns
        ids = {d for d, _ in pairs(after)}
        if name == "quality":
            scores = {r.doc_id: r.predicted for r in quality.classify(kept, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
            wanted = {d for d, _ in before if scores[d]}
        elif name == "exact_dedup":
            wanted = {r[0] for r in copies(before) if r[3]}
        elif name == "simhash_dedup":
            wanted = {r[0] for r in near(before, [slow_fingerprint(t) for _, t in before]) if r[0] == r[2]}
        else:
            wanted = {r[0] for r in leaks(before, items) if not r[5]}
        assert ids == wanted
        kept = after
    check_packing(rows_of(P.STAGES[-1][1](spark, kept, sf_dir), *PACKED), pairs(kept))
    ran = P.run(spark, sf_dir)
    assert {r[0] for r in ran.select("doc_id").distinct().collect()} == {d for d, _ in pairs(kept)}


def test_odd_documents(spark, sf_dir, odd_docs, no_docs):
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, odd_docs, sf_dir)
        assert out.columns == odd_docs.columns
        assert set(map(repr, pairs(out))) <= set(map(repr, pairs(odd_docs)))
        assert stage(spark, no_docs, sf_dir).count() == 0
    assert P.STAGES[-1][1](spark, no_docs, sf_dir).count() == 0
    assert P.STAGES[-1][1](spark, odd_docs, sf_dir).agg(F.sum(F.when(F.col("start") == 0, 1))).first()[0] == odd_docs.count()


def test_rows_that_share_an_id(spark, sf_dir, odd_docs):
    """Exact dedup keeps one of repeated rows; rows with one id and different texts are judged by themselves."""
    text = "The quick brown fox jumps over the lazy dog and runs far away from here."
    assert [r for r in pairs(P.exact_dedup(spark, odd_docs, sf_dir)) if r[1] == text] == [(1, text)]
    twice = spark.createDataFrame([(1, "some words"), (1, "some words"), (1, "quite another text"), (2, "some  words"), (None, None), (None, "")], "doc_id long, text string")
    left = pairs(P.exact_dedup(spark, twice, sf_dir))
    assert sorted(t or "" for _, t in left) == ["", "quite another text", "some words"]
    assert sorted(t or "" for _, t in pairs(P.simhash_dedup(spark, written(P.exact_dedup(spark, twice, sf_dir), "t"), sf_dir))) == ["", "quite another text", "some words"]
