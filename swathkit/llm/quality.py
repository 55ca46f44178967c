"""Quality classifier by positive-unlabelled learning.

Texts are described by N_FEATURES numbers (letters, case, symbols, repetition, lines, word lengths; no label, language,
source or id). Trusted positives are training rows of label 1, at most MAX_POSITIVE of them by a hash of the id. Unlabelled
are all documents outside the held-out fold, whatever their label; means and scales are theirs too. The model, logistic over
standardised features and their squares, minimises the non-negative unbiased risk

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

Adam steps on a sample of START_ROWS unlabelled rows give the start. Then Newton steps go over all unlabelled rows: gradient,
curvature and risk are summed by the executors, a row a task, and a step that makes the bracket negative, or the risk larger,
is halved. The class prior is the share of label 1 among training rows. Features are computed once for a whole table, and
training and scoring read them.

Defined results: null and empty texts get the features of no words, and a score like any other; very long texts are described
whole. Rows without a doc_id are scored, and are not held out. Of several labels for an id the majority counts, a tie as 1.
Equal scores are not told apart. Without any training label the score is 0.5. Repeated rows each get their row. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.llm.common import documents, prepare, table, written
from swathkit.llm.labelled import held_out, sample_of_labels, training_labels

MAX_POSITIVE, START_ROWS, STEPS, RATE, RIDGE = 12_000, 24_000, 600, 0.05, 1e-4
NEWTON, HALVINGS = 4, 4  # steps over all rows, and how often one is halved
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
UPPER, LOWER, DIGIT, SYMBOL, BREAK = re.compile(r"[A-Z]"), re.compile(r"[a-z]"), re.compile(r"[0-9]"), re.compile(r"[#$%&*|<>{}\[\]\\^~_=+@/]"), re.compile(r"[.!?]+(?:\s|$)")
N_FEATURES = 24


def features(text: str) -> list[float]:
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * N_FEATURES
    counts = Counter(words)
    letters = sum(map(str.isalpha, text))
    raw = text.encode()
    upper, digits, symbols = len(UPPER.findall(text)), len(DIGIT.findall(text)), len(SYMBOL.findall(text))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct_lines = len(set(lines))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = Counter(zip(words, words[1:], strict=False))
    repeated_pairs = sum(c for c in pairs.values() if c > 1) / max(n - 1, 1)
    all_upper = sum(w.isupper() and len(w) > 1 for w in words)
    trigrams = list(zip(words, words[1:], words[2:], strict=False))
    repeated_three = 1 - len(set(trigrams)) / len(trigrams) if trigrams else 0.0
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = len(BREAK.findall(text))
    alpha_words = sum(map(str.isalpha, words))
    top = counts.most_common(1)[0][1]
    return [
        letters / chars, upper / max(letters, 1), digits / chars, symbols / chars, text.count("!") / n, text.count("|") / n,
        text.count(".") / n, text.count(",") / n, all_upper / n, len(counts) / n, len(counts) / math.sqrt(n), same / n,
        repeated_pairs, repeated_three, top / n, float(lengths.mean()), float(lengths.std()), float(lengths.max() > 30), math.log1p(n),
        1 - distinct_lines / len(lines), len(lines) / n, ends / n, alpha_words / n, (len(raw) - chars) / chars,
    ]


def expanded(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -6, 6)
    return np.hstack([x, x * x, np.ones((len(x), 1))])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, moments: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights by Adam, and the mean and scale that standardise features (those of the unlabelled, if not given)."""
    mean, scale = moments or (unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6)
    p, u = expanded((positive - mean) / scale), expanded((unlabelled - mean) / scale)
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    for t in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        negative = softplus(gu).mean() - prior * softplus(gp).mean()
        d_pos = -prior * (p * sigmoid(-gp)[:, None]).mean(axis=0)
        d_neg = (u * sigmoid(gu)[:, None]).mean(axis=0) - prior * (p * sigmoid(gp)[:, None]).mean(axis=0)
        g = (d_pos + d_neg if negative >= 0 else -d_neg) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w, mean, scale


def polish(model: tuple[np.ndarray, np.ndarray, np.ndarray], positive: np.ndarray, prior: float, sums: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model after Newton steps over all unlabelled rows; sums(w): their mean softplus, gradient and curvature at w.

    With the logistic loss l(g) - l(-g) = -g, so while the bracket is not negative the risk is convex in w.
    """
    w, mean, scale = model
    p = expanded((positive - mean) / scale)

    def at(x: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        loss, slope, curve = sums(x)
        bracket = loss - prior * float(softplus(p @ x).mean())
        return prior * float(softplus(-(p @ x)).mean()) + max(0.0, bracket) + RIDGE / 2 * float(x @ x), bracket, slope, curve

    risk, bracket, slope, curve = at(w)
    for _ in range(NEWTON):
        g = slope - prior * p.mean(axis=0) + RIDGE * w
        step = np.linalg.solve(curve + RIDGE * np.eye(len(w)), g) if bracket >= 0 else 0.2 * w
        for k in range(HALVINGS + 1):
            new = w - step / 2**k
            found = at(new)
            if found[1] >= 0 and (found[0] <= risk or bracket < 0) or bracket < 0 and found[1] > bracket:
                break
        else:
            break
        small = np.abs(new - w).max() < 1e-3
        w, (risk, bracket, slope, curve) = new, found
        if small:
            break
    return np.round(w, 6), mean, scale  # sums by executors differ in their last digits


def score(x: np.ndarray, model: tuple | None) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    w, mean, scale = model
    return 1 / (1 + np.exp(-np.clip(expanded((x - mean) / scale) @ w, -30, 30)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "x"])


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and features x of every row, written to the shared folder: some 100 bytes a row."""
    prepare(docs.sparkSession)
    return written(documents(docs, id_col, text_col).mapInArrow(_featured, "doc_id long, x array<float>"), "quality-features")


def _summing(model: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Sums over rows of softplus, of the gradient, and of the curvature, as one row a task."""
    w, mean, scale = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(w)
        loss, slope, curve = 0.0, np.zeros(n), np.zeros((n, n))
        for b in batches:
            u = expanded((matrix(b.column(0)) - mean) / scale)
            g = u @ w
            s = sigmoid(g)
            loss, slope, curve = loss + softplus(g).sum(), slope + s @ u, curve + (u * (s * (1 - s))[:, None]).T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 + n + n * n, dtype=np.int32)), pa.array(np.concatenate([[loss], slope, curve.ravel()]))], names=["k", "v"])

    return run


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), N_FEATURES)


def train(feats: DataFrame, labels: DataFrame) -> tuple | None:
    """The model, from training rows of featured() alone; None without positives."""
    rows = training_labels(labels, "quality", FOLDS, HELD_OUT)
    n_labels, prior = rows.agg(F.count("*"), F.avg("y")).first()
    if not n_labels or not prior:
        return None
    positives = F.broadcast(sample_of_labels(rows.filter("y = 1"), MAX_POSITIVE).select("doc_id"))
    p = np.array([r[0] for r in feats.join(positives, "doc_id").select("x").limit(MAX_POSITIVE).collect()], float)
    if not len(p):
        return None
    unlabelled = feats.filter(~held_out(F.col("doc_id"), FOLDS, HELD_OUT)).select("x")
    at = [F.col("x")[k].cast("double") for k in range(N_FEATURES)]
    n, *found = unlabelled.agg(F.count("*"), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    mean, scale = np.array(found[:N_FEATURES]), np.array(found[N_FEATURES:]) + 1e-6
    start = unlabelled.filter(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int(0.95 * START_ROWS / n * (1 << 30))) if n > START_ROWS else unlabelled
    model = fit(p, np.array([r[0] for r in start.limit(START_ROWS).collect()], float), prior, moments=(mean, scale))

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        parts = unlabelled.mapInArrow(_summing((w, mean, scale)), "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
        v = np.zeros(1 + len(w) + len(w) ** 2)
        for k, x in parts.collect():
            v[k] = x / n
        return float(v[0]), v[1 : 1 + len(w)], v[1 + len(w) :].reshape(len(w), len(w))

    return polish(model, p, prior, sums)


def feature_score(x: Column, model: tuple | None) -> Column:
    """The score of each row of features."""

    @F.pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(score(np.array(rows.tolist(), float).reshape(len(rows), N_FEATURES), model))

    return run(x)


def score_column(text: Column, model: tuple | None) -> Column:
    """The score of each text, by a vectorised UDF; adds no shuffle, and columns beside it stay."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(score(np.array([features(t) for t in texts], np.float32).astype(float).reshape(len(texts), N_FEATURES), model))

    return run(F.coalesce(text.cast("string"), F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    feats = featured(docs, id_col, text_col)
    scored = feats.withColumn("score", feature_score(F.col("x"), train(feats, labels)))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
