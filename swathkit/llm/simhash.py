"""SimHash near-dedup with Golay-code fuzzy keys.

Fingerprint: A-Z lower-cased, words between [\\x20\\x09-\\x0D]+, 3-word shingles (repeats count; fewer words: the whole
sequence), XXH64 (seed 42) of each; a bit is set if more than half of the hashes have it; no words give zero. Two
fingerprints link if they differ in at most MAX_BITS = 2 bits.

Finding links: the fingerprint is cut into segments of 22, 21 and 21 bits. If two fingerprints differ in at most two bits,
one of the three segments agrees (pigeonhole), and any other differs in at most two. The binary Golay code [23, 12, 7] is
perfect: each 23-bit word is within 3 of one codeword, and if it is at 3, within 4 of five more. Words at distance 2 or
less always share one of these (the word between them is within 3 of a codeword that is within 4 of both). So the keys
(which segment, its value, a codeword index of the next segment), 3 to 18 a fingerprint, find all links; a join on the
key verifies the distance. A key of more than MAX_BUCKET fingerprints is not joined: its fingerprints instead take all
65 words within one bit of them, and fingerprints at distance 2 or less are exactly those that share such a word, of
which no more than 65 exist. This loses nothing and makes no pairs.

Only distinct fingerprints are joined; copies follow their fingerprint's class.

Defined results: null and empty texts have fingerprint zero and are linked like any other. A null doc_id never names a
component unless all of it is null. Repeated rows each get their row. Very long texts are hashed whole. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.llm.common import documents, prepare, skew_join, table, written
from swathkit.llm.graph import components

SHINGLE, SEED, MAX_BITS, MAX_BUCKET = 3, 42, 2, 64
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
GOLAY = 0b110001110101  # generator of the [23, 12, 7] code


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator, 11 bits."""
    x = words.astype(np.int64).copy()
    for b in range(22, 10, -1):
        x ^= np.where(x >> b & 1, GOLAY << (b - 11), 0)
    return x


def _patterns() -> np.ndarray:
    """By syndrome: the error pattern of weight 3 or less, then those of weight 4 (five where the first has weight 3), then -1."""
    out = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        for e, s in zip(errors, syndrome(errors), strict=True):
            out[s, filled[s]] = e
            filled[s] += 1
    return out


PATTERNS = _patterns()


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within 3 of each word, or within 4 if that is at 3: n x 6, -1 for none."""
    e = PATTERNS[syndrome(words)]
    return np.where(e >= 0, (words.astype(np.int64)[:, None] ^ e) >> 11, -1)


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line, h64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return h64(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    hashes = np.array([h64(line[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), size, seed) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), fp (the fingerprint as a signed long)."""
    prepare(docs.sparkSession)
    base = documents(docs, id_col, text_col)
    return base.select("doc_id", F.col("text").cast("binary"), F.xxhash64("text").alias("text_hash")).mapInArrow(_fingerprints(size, seed), "doc_id long, text_hash long, fp long")


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of signed 64-bit fingerprints: (key, position in fp)."""
    raw, keys, rows = fp.view(np.uint64), [], []
    parts = [(raw >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    for k in range(3):
        near = codewords(parts[(k + 1) % 3])
        row, col = np.nonzero(near >= 0)
        keys.append(k << 34 | parts[k][row] << 12 | near[row, col])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy()
        key, row = golay_keys(fp)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])


def links(distinct: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b) over the distinct fingerprints fp: enough links at MAX_BITS or less to connect all that such links connect."""
    keys = written(distinct.select("fp").mapInArrow(_keys, "key long, fp long"), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    held = written(keys.join(sizes, "key"), "golay-buckets")
    cold = held.filter(F.col("n") <= max_bucket).select("key", "fp")
    other = cold.select(F.col("key"), F.col("fp").alias("b"))
    pairs = cold.withColumnRenamed("fp", "a").join(other, "key").filter((F.col("a") < F.col("b")) & (F.expr("bit_count(a ^ b)") <= MAX_BITS)).select("a", "b")
    hot = held.filter(F.col("n") > max_bucket).select("fp").distinct()
    masks = [0, *(1 << b for b in range(63)), -(1 << 63)]
    ball = hot.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in masks])).alias("z"))
    stars = ball.groupBy("z").agg(F.collect_list("fp").alias("f")).filter(F.size("f") > 1)  # at most 65 each
    rays = stars.select(F.array_min("f").alias("a"), F.explode("f").alias("b")).filter("a != b")
    return pairs.unionByName(rays)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = MAX_BUCKET, text_hash: bool = False) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links); text_hash adds the xxhash64 of the text."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = components(links(classes, max_bucket))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = linked.select("fp", "n", "root").join(firsts, "root").select("fp", "n", "component_id")
    out = skew_join(rows, written(labels, "labels"), "fp", "n", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *["text_hash"] * text_hash)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
