"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Folding: lower case; zero-width characters go; letters of other scripts that look Latin, and full-width forms, become
Latin; inside a word that has letters on both sides or before it, digits and signs that stand for letters become them.
The folded text is words between single spaces. Entries are whole words (" word ") and stems (" stem", any ending), so
that inflected forms are found; exception phrases are two words (" word next ", " previous word "): a hit inside one does
not count. Of several entries at one word the heaviest counts. A document's score is logistic in the weight of its distinct
hits, that weight by length, the numbers of hits, the heaviest, and its length.

Learning (training rows alone, at most MAX_TRAIN of them, by a hash of the id; equal texts count once): words and stems are
counted in all sampled texts, by part, on the executors. A term's weight is its log-odds of being toxic above the usual, less a
standard error; only terms whose weight is large enough, in all or without one of the parts, leave the executors. Phrases
with a term that are clean get exceptions. The logistic scale is fitted across PARTS parts: each part's texts are measured with the lexicon of the
other parts' counts, so no text is measured with terms learned from it.

Defined results: null and empty texts have no hits and the score that goes with none; very long texts are folded and matched
whole. Equal scores are not told apart; of several labels for an id the majority counts, a tie as 1. Rows without a doc_id are scored and
are not held out. Without training labels of both kinds the built-in lexicon is empty and the score is 0. Repeated rows
each get their row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.llm.common import documents, prepare, table, written
from swathkit.llm.labelled import held_out, sample_of_labels, training_labels, with_text

MAX_TRAIN, LEAST_DOCS, LEAST_WEIGHT, PARTS = 16_000, 3, 2.0, 4
STEM = (3, 8)  # letters of a stem; the word has more
THRESHOLD, FOLDS, HELD_OUT = 0.7, 3, 1

_LOOKALIKE = "аaеeоoрpсcуyхxіiјjѕsһhԁdԛqԝwвbкkмmнhтtьbзeгrпnαaβbγyεeηnιiκkνvοoρpτtυuχxωwⅰiⅼlɡgıi"
HOMOGLYPHS = {ord(a): b for a, b in zip(_LOOKALIKE[::2], _LOOKALIKE[1::2], strict=True)} | {0xFF41 + k: chr(97 + k) for k in range(26)} | {0xFF10 + k: chr(48 + k) for k in range(10)} | dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD), "")
FOREIGN = re.compile(r"[ıɡͰ-ԯ​-‍⁠ⅰ-ⅿ﻿０-ｚ­]")
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"})
MIXED = re.compile(r"(?<![^\W\d_])[0-9@$]?[^\W\d_]+(?:[0-9@$!|]+[^\W\d_]+)+[0-9]?|[^\W\d_]{2,}[0-9]{1,2}(?!\w)|(?<!\w)[0-9][^\W\d_]{2,}")
APART = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """The text as folded words, each between single spaces."""
    line = text.lower()
    if not line.isascii() and FOREIGN.search(line):
        line = line.translate(HOMOGLYPHS)
    line = MIXED.sub(lambda m: m[0].translate(SIGNS), line)
    return f" {APART.sub(' ', line).strip()} "


@dataclass
class Lexicon:
    """Weights by word or stem ("stem*"), and exception phrases (folded, words between single spaces)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()

    def __post_init__(self):
        self.automaton = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions}

    def __setstate__(self, state):
        self.__dict__.update(state, automaton=None)

    def hits(self, folded: str) -> list[tuple[str, float]]:
        """The heaviest entry at each word outside exception phrases, with its weight."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for w, x in self.weights.items():
                pattern = f" {w[:-1]}" if w.endswith("*") else f" {w} "
                self.automaton.add_word(pattern, (w, x, len(pattern)))
            for phrase in self.exceptions:
                self.automaton.add_word(f" {phrase} ", (phrase, None, len(phrase) + 2))
            if len(self.automaton):
                self.automaton.make_automaton()
        if not len(self.automaton):
            return []
        found: dict[int, tuple[str, float]] = {}
        spared: set[int] = set()
        for end, (w, x, size) in self.automaton.iter(folded):
            at = end - size + 1
            if x is None:
                spared.update((at, at + w.index(" ") + 1))
            elif at not in found or x > found[at][1]:
                found[at] = w, x
        return [hit for at, hit in found.items() if at not in spared]


def numbers(folded: str, lexicon: Lexicon) -> list[float]:
    hits = lexicon.hits(folded)
    n = max(folded.count(" ") - 1, 1)
    distinct = dict(hits)
    total = sum(distinct.values())
    rate = 100 * total / n
    return [math.log1p(total), math.log1p(rate), math.log1p(len(distinct)), math.log1p(len(hits)), math.log1p(n), float(bool(hits)), max(distinct.values(), default=0.0), math.log1p(total) * math.log1p(rate)]


def fit_scale(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * max(1, len(x)) / 100)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def candidates_of(folded: str) -> set[str]:
    """Words of three letters or more, and stems."""
    words = set(folded.split())
    return {w for w in words if len(w) >= 3} | {w[:k] + "*" for w in words for k in range(STEM[0], min(STEM[1], len(w) - 1) + 1)}


def phrases_of(folded: str, lexicon: Lexicon) -> set[str]:
    """Pairs of words in a row of which one is hit."""
    hit = {w for w, _ in lexicon.hits(folded)}
    if not hit:
        return set()
    words = folded.split()
    at = [w in hit or any(w[:k] + "*" in hit for k in range(STEM[0], min(STEM[1], len(w) - 1) + 1)) for w in words]
    return {f"{x} {y}" for x, y, a, b in zip(words, words[1:], at, at[1:], strict=False) if a or b}


def weigh(counts: Iterable[tuple[str, int, int]], n: int, n_toxic: int) -> dict[str, float]:
    """Weights of terms from (term, documents, toxic documents) out of n documents, n_toxic of them toxic.

    Counts are smoothed by one document of the usual mix. A stem that a single longer entry accounts for is left out.
    """
    if not 0 < n_toxic < n:
        return {}
    share = n_toxic / n
    out, toxic_of = {}, {}
    for term, docs, toxic in counts:
        a, b = toxic + share, docs - toxic + 1 - share
        w = math.log(a / b) - math.log(share / (1 - share)) - math.sqrt(1 / a + 1 / b)
        if toxic >= LEAST_DOCS and w >= LEAST_WEIGHT:
            out[term], toxic_of[term] = round(min(w, 8.0), 3), toxic
    longer: Counter = Counter()
    for term, toxic in toxic_of.items():
        body = term.rstrip("*")
        for k in range(STEM[0], min(STEM[1], len(body) - 1) + 1):
            longer[body[:k] + "*"] = max(longer[body[:k] + "*"], toxic)
    return {t: w for t, w in out.items() if not t.endswith("*") or toxic_of[t] > longer[t]}


@dataclass
class Model:
    lexicon: Lexicon
    scale: np.ndarray | None

    def score(self, texts: Iterable[str]) -> np.ndarray:
        texts = list(texts)
        if self.scale is None or not texts:
            return np.zeros(len(texts))
        x = np.array([numbers(fold(t), self.lexicon) for t in texts])
        return 1 / (1 + np.exp(-np.clip(x @ self.scale[:-1] + self.scale[-1], -30, 30)))


def _counting(find: Callable[[str], set[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, toxic = Counter(), Counter()
            for text, y, part in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = [(t, part) for t in find(fold(text.as_py()))]
                docs.update(found)
                if y:
                    toxic.update(found)
            yield pa.RecordBatch.from_pydict({"term": pa.array([t for t, _ in docs], pa.string()), "part": pa.array([p for _, p in docs], pa.int32()), "docs": pa.array(list(docs.values()), pa.int64()), "toxic": pa.array([toxic[t] for t in docs], pa.int64())})

    return run


def _counts(rows: DataFrame, find: Callable[[str], set[str]], *by: str) -> DataFrame:
    """Documents and toxic documents of each term (and part)."""
    return rows.select("text", "y", "part").mapInArrow(_counting(find), "term string, part int, docs long, toxic long").groupBy("term", *by).agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))


def heavy_terms(counts: DataFrame, size: dict[int, tuple[int, int]]) -> DataFrame:
    """term, its documents by part, its toxic documents by part: for terms that weigh() may keep in all parts, or without one of them."""
    n, n_toxic = (sum(x[k] for x in size.values()) for k in (0, 1))
    own = lambda c, k: F.sum(F.when(F.col("part") == k, F.col(c)).otherwise(0)).cast("long")
    rows = counts.groupBy("term").agg(*[own("docs", k).alias(f"d{k}") for k in range(PARTS)], *[own("toxic", k).alias(f"t{k}") for k in range(PARTS)])
    keep = F.lit(False)
    for left_out in (None, *range(PARTS)):
        rest, rest_toxic = (n, n_toxic) if left_out is None else (n - size[left_out][0], n_toxic - size[left_out][1])
        if not 0 < rest_toxic < rest:
            continue
        docs, toxic = (sum((F.col(f"{c}{k}") for k in range(PARTS) if k != left_out), F.lit(0)) for c in "dt")
        share = rest_toxic / rest
        a, b = toxic + share, docs - toxic + 1 - share
        weight = F.log(a / b) - math.log(share / (1 - share)) - F.sqrt(1 / a + 1 / b)
        keep = keep | ((toxic >= LEAST_DOCS) & (weight >= LEAST_WEIGHT - 1e-6))
    return rows.filter(keep)


def _numbering(lexicons: list[Lexicon]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [numbers(fold(t.as_py()), lexicons[k]) for t, k in zip(b.column(0), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon and scale from training rows; at most MAX_TRAIN of them."""
    prepare(docs.sparkSession)
    sample = sample_of_labels(training_labels(labels, "toxic", FOLDS, HELD_OUT), MAX_TRAIN)
    texts = with_text(docs, sample, id_col, text_col).groupBy("text").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    texts = written(texts.withColumn("part", F.pmod(F.xxhash64("text", F.lit("part")), F.lit(PARTS)).cast("int")), "toxicity-sample")
    size = {k: (0, 0) for k in range(PARTS)} | {r[0]: (r[1], r[2]) for r in texts.groupBy("part").agg(F.count("*"), F.sum("y")).collect()}
    n, n_toxic = (sum(x[k] for x in size.values()) for k in (0, 1))
    if not 0 < n_toxic < n:
        return Model(Lexicon(), None)
    by_part: dict[str, dict[int, tuple[int, int]]] = {}
    for term, *own in heavy_terms(_counts(texts, candidates_of, "part"), size).collect():
        by_part[term] = {k: (own[k], own[PARTS + k]) for k in range(PARTS) if own[k]}
    whole = {term: tuple(map(sum, zip(*own.values(), strict=True))) for term, own in by_part.items()}
    lexicon = Lexicon(weigh(((t, *c) for t, c in whole.items()), n, n_toxic))
    if lexicon.weights:
        found = _counts(texts, lambda folded: phrases_of(folded, lexicon)).filter((F.col("docs") >= 5) & (F.col("toxic") * 4 <= F.col("docs")))
        lexicon.exceptions = tuple(sorted(r[0] for r in found.select("term").collect()))
        lexicon.automaton = None
    others = []
    for k in range(PARTS):
        rest = ((t, c[0] - own.get(k, (0, 0))[0], c[1] - own.get(k, (0, 0))[1]) for t, c in whole.items() for own in [by_part[t]])
        others.append(Lexicon(weigh(rest, n - size[k][0], n_toxic - size[k][1]), lexicon.exceptions))
    got = texts.select("text", "y", "part").mapInArrow(_numbering(others), "x array<double>, y int").collect()  # at most MAX_TRAIN
    y = np.array([r[1] for r in got], float)
    return Model(lexicon, fit_scale(np.array([r[0] for r in got], float), y))


def score_column(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    return run(F.coalesce(text.cast("string"), F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col)
    scored = documents(docs, id_col, text_col).withColumn("score", score_column(F.col("text"), model))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
