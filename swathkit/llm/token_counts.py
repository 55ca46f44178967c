"""Token counts under a unigram model, with a trie of distinct pre-tokens.

A text's pre-tokens are its words between [\\x20\\x09-\\x0D]+, each with a word mark before it. The model has the pieces of
a public vocabulary. Tokenizers are not trained here, so no probabilities are estimated; as the vocabulary gives ranks alone, a
piece of rank r has the Zipf-Mandelbrot log probability -log(r + SHIFT). A character without a piece is its UTF-8 bytes, one
token each at a floor score. The count of a pre-token is the number of tokens of its best segmentation (the highest score; of
equals the fewest tokens).

Each task inserts the distinct pre-tokens of a batch in a trie: in sorted order a pre-token shares the path of its
longest common prefix with the one before, so forward scores (best score and count for each prefix) are computed once a
trie node and kept on a stack; the counts at terminals go to a cache bounded in words and in bytes. Documents need no shuffle.

Defined results: null and empty texts have no pre-tokens and no tokens. Repeated rows each get their row. An empty table
gives an empty result. Extra columns are ignored. Pre-tokens of any length are counted whole.
"""

from __future__ import annotations

import math
from collections import ChainMap
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.llm.common import documents, prepare, table
from swathkit.llm.tokens import vocabulary

MARK, SHIFT, CACHE_WORDS, CACHE_WORD = "▁", 2.7, 400_000, 64  # words that a task keeps, and bytes of the longest

_MODELS: dict[str, Unigram] = {}


@dataclass
class Unigram:
    """Log probabilities by piece, the longest piece, and the score of a byte."""

    pieces: dict[str, float]
    longest: int
    floor: float

    @classmethod
    def of(cls, ranked: Iterable[str]) -> Unigram:
        pieces = {p: -math.log(k + SHIFT) for k, p in enumerate(dict.fromkeys(ranked))}
        return cls(pieces, max(map(len, pieces), default=1), min(pieces.values(), default=0.0) - 10)


def model(path: str) -> Unigram:
    """The model of a sentencepiece file's vocabulary, one a process."""
    if path not in _MODELS:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [k for k in range(sp.get_piece_size()) if not (sp.is_unknown(k) or sp.is_control(k) or sp.is_byte(k) or sp.is_unused(k))]
        _MODELS[path] = Unigram.of(sp.id_to_piece(k) for k in sorted(ids, key=lambda k: (-sp.get_score(k), k)))
    return _MODELS[path]


def shared_prefix_counts(words: Iterable[str], uni: Unigram) -> dict[str, int]:
    """Tokens of each distinct pre-token; forward scores are computed once for each distinct prefix."""
    out: dict[str, int] = {}
    pieces, longest, floor = uni.pieces, uni.longest, uni.floor
    last, best, count = "", [0.0], [0]
    for word in sorted(set(words)):
        common, most = 0, min(len(last), len(word))
        while common < most and last[common] == word[common]:
            common += 1
        del best[common + 1 :], count[common + 1 :]
        for end in range(common + 1, len(word) + 1):
            score, n = -math.inf, 0
            for start in range(max(0, end - longest), end):
                p = pieces.get(word[start:end])
                if p is None:
                    if end - start > 1:
                        continue
                    width = len(word[start].encode("utf-8", "surrogatepass"))
                    s, c = best[start] + width * floor, count[start] + width
                else:
                    s, c = best[start] + p, count[start] + 1
                if s > score or (s == score and c < n):
                    score, n = s, c
            best.append(score)
            count.append(n)
        last = word
        out[word] = count[-1]
    return out


def _counting(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, cache = model(path), {}
        for b in batches:
            texts = [t.as_py().split() for t in b.column(1)]
            new = {w for words in texts for w in words}.difference(cache)
            if len(cache) + len(new) > CACHE_WORDS:
                cache.clear()
                new = {w for words in texts for w in words}
            names = {w: MARK + w.decode("utf-8", "replace") for w in new}
            counts = shared_prefix_counts(names.values(), uni)
            cache.update((w, counts[s]) for w, s in names.items() if len(w) <= CACHE_WORD)
            long = {w: counts[s] for w, s in names.items() if len(w) > CACHE_WORD}
            get = ChainMap(long, cache).__getitem__ if long else cache.__getitem__
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in texts], pa.int64()), pa.array([sum(map(get, w)) for w in texts], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_tokens."""
    prepare(docs.sparkSession)
    base = documents(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary"))
    return base.mapInArrow(_counting(path), "doc_id long, n_words long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
