"""Quality and toxicity: held-out accuracy, no leaks, and the method's parts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathkit.llm import quality as Q
from swathkit.llm import toxicity as T
from tests.llm.conftest import TEXTS, rows_of

CASES = [(Q, "quality", 4, 2), (T, "toxic", 3, 1)]


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("module", "label", "folds", "fold"), CASES)
def test_held_out_accuracy(spark, module, label, folds, fold):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = module.classify(docs, labels)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % folds == fold}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    y, s = np.array([r.y for r in held]), np.array([r.score for r in held])
    assert auc(s, y) > 0.8 and np.mean([r.predicted == r.y for r in held]) > 0.9


@pytest.mark.parametrize(("module", "label", "folds", "fold"), CASES)
def test_held_out_labels_are_not_used(spark, sf_dir, module, label, folds, fold):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % folds == fold
    turned = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("same")})
    assert rows_of(module.classify(docs, labels)) == rows_of(module.classify(other, turned))


@pytest.mark.parametrize(("module", "label", "folds", "fold"), CASES)
def test_odd_documents(spark, sf_dir, odd_docs, no_docs, module, label, folds, fold):
    odd_labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1), (4, 0), (6, 1), (7, 0), (8, 1), (9, 0), (10, 0)], f"doc_id long, {label} int").withColumn("text", F.lit("clash"))
    got = module.classify(odd_docs, odd_labels)
    assert got.count() == len(TEXTS) and got.filter("score is null or score < 0 or score > 1").isEmpty()
    assert got.filter("doc_id is null and held_out").isEmpty()
    same = {r.score for r in got.filter("doc_id in (3, 4, 5)").collect()}
    assert len(same) == 1  # null, empty and blank texts
    assert module.classify(no_docs, odd_labels).count() == 0
    default = 0.5 if module is Q else 0.0
    assert {r.score for r in module.classify(odd_docs, odd_labels.filter("false")).collect()} == {default}


def test_positive_unlabelled_risk():
    """Without any negative label, the two kinds that make up the unlabelled are told apart."""
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (2000, 3))
    model = Q.fit(good[:1000], np.concatenate([good[1000:3000], bad[:1000]]), 2 / 3)
    p, n = Q.score(good[3000:], model), Q.score(bad[1000:], model)
    assert (p >= 0.5).mean() > 0.95 and (n < 0.5).mean() > 0.95


def test_folding():
    assert T.fold("Ｈｅｌｌо  W0RLD, b4d​word 123 x1") == " hello world badword x "
    assert T.fold("аbсd­") == " abcd " and T.fold("") == "  " and T.fold("$h1t 2024") == " shit "


def test_exceptions_and_whole_words():
    lex = T.Lexicon({"foul": 3.0, "vile": 2.0}, ("foul play",))
    hits = lambda s: [w for w, _ in lex.hits(T.fold(s))]
    assert hits("Foul play!") == [] and hits("f0ul vile foul play") == ["foul", "vile"] and hits("foulest viler") == []
    assert hits("foul foul") == ["foul", "foul"]
    stems = T.Lexicon({"foul*": 2.0, "foully": 3.0})
    assert stems.hits(T.fold("fouler foully befoul foul")) == [("foul*", 2.0), ("foully", 3.0), ("foul*", 2.0)]
    assert T.Lexicon().hits(" a ") == []
    import pickle

    assert pickle.loads(pickle.dumps(lex)).hits(" vile ") == [("vile", 2.0)]


def test_length_counts():
    lex = T.Lexicon({"foul": 3.0})
    short, long = (T.numbers(T.fold("foul " + "word " * n), lex) for n in (5, 500))
    assert short[0] == long[0] and short[1] > long[1]


def test_letters_are_counted_alike_at_every_length():
    unit = "Ab ½ x² Ⅳ ① é 中 9_ "
    for times in (1, 99, 100, 101, 1000):
        text = unit * times
        share, upper = Q.features(text)[:2]
        assert share == 5 / len(unit) and upper == 1 / 5
