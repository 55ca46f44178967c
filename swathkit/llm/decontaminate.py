"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Normal form: A-Z become a-z, then words are runs of digits, a-z and non-ASCII characters. Ten consecutive words of an item
are a window (all its words if it has fewer). A document is scanned once; a word inside an occurrence of a window is hit,
and hits are mapped to offsets in the original text.

Scale: items are read to the driver only in shares of at most MAX_WINDOW_BYTES of text, a checked bound; each share is
one automaton, built once per Python worker. A larger benchmark takes several passes, whose hits are merged by document.

Defined results: null and empty texts have no words and no hits; items without words (or with a null id) have no
windows; repeated items count once per distinct item_id; an empty benchmark leaves every document clean; repeated
document rows each get their row. Very long texts are scanned whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathkit.llm.common import batches_of, documents, prepare, table, written

WINDOW = 10
MAX_WINDOW_BYTES = 16 << 20
#: Bytes of UTF-8: what separates words becomes a space, A-Z become a-z.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # before A-Z become a-z

HITS = T.StructType([
    T.StructField("rid", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("char_starts", T.ArrayType(T.LongType())), T.StructField("char_ends", T.ArrayType(T.LongType())),
])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows(items: list[tuple[str, bytes]], size: int = WINDOW) -> dict[bytes, set[str]]:
    """Windows of the items, as words between single spaces, with the ids of the items that have them."""
    out: dict[bytes, set[str]] = {}
    for item, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - size + 1) if words else 0):
            out.setdefault(b" " + b" ".join(words[k : k + size]) + b" ", set()).add(item)
    return out


class Scanner:
    """Finds windows in documents."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        self.automaton = ahocorasick.Automaton()
        for w, ids in windows(items, size).items():
            self.automaton.add_word(w.decode("latin-1"), (w.count(b" ") - 1, sorted(ids)))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, maximal runs (first word, past last word) of hit words, ids of the items found."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), [], set()
        line = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return len(words), [], set()
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        runs: list[list[int]] = []
        ids: set[str] = set()
        for end, (n, items) in found:
            stop = int(np.searchsorted(gaps, end))
            start = stop - n
            ids.update(items)
            while runs and runs[-1][1] >= start:  # ends ascend, starts of longer windows may not
                start = min(start, runs.pop()[0])
            runs.append([start, stop])
        return len(words), [(a, b) for a, b in runs], ids


_SCANNERS: dict[tuple, Scanner] = {}


def scanner_of(share, size: int) -> Scanner:
    """The scanner of a broadcast share; a process keeps the last one."""
    key = (share._path or id(share), size)
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(share.value, size)
    return _SCANNERS[key]


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as (start, end) character offsets in the original text."""
    if not runs:
        return []
    raw = text.encode()
    at = [(m.start(), m.end()) for m in WORD.finditer(raw)]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # characters before each byte
    return [(int(chars[at[a][0]]), int(chars[at[b - 1][1]])) for a, b in runs]


def shares(benchmark: DataFrame, id_col: str, text_col: str) -> list[list[tuple[str, bytes]]]:
    """The items in shares of bounded size (an item larger than the bound has a share of its own)."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("binary").alias("text")).dropna()
    items = items.withColumn("size", F.length("text"))
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = max(1, -(-total // MAX_WINDOW_BYTES))
    share = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [[(r[0], bytes(r[1])) for r in items.filter(share == k).select("item", "text").toLocalIterator()] for k in range(n)]


def _scanned(share, size: int, only_hits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(share, size)
        schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("char_starts", pa.list_(pa.int64())), ("char_ends", pa.list_(pa.int64()))])

        def rows():
            for b in batches:
                for rid, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    raw = text.as_py()
                    n, runs, ids = scanner.scan(raw)
                    if runs or not only_hits:
                        chars = spans(raw.decode(), runs)
                        yield rid, doc, n, [x for x, _ in runs], [x for _, x in runs], sorted(ids), [x for x, _ in chars], [x for _, x in chars]

        yield from batches_of(schema, rows(), 2000)

    return run


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """Per row of docs: rid, doc_id, n_words, starts and ends of hit word runs, items (sorted ids of the items found), and char_starts and char_ends, the same runs as character offsets in the original text."""
    spark = prepare(docs.sparkSession)
    base = documents(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("binary").alias("text"))
    parts = shares(benchmark, item_col, item_text)
    if len(parts) == 1:
        return base.mapInArrow(_scanned(spark.sparkContext.broadcast(parts[0]), size, False), HITS)
    # More than one share: write the texts' row ids once, so that each pass means the same rows.
    base = written(base, "decontaminate")
    out = base.mapInArrow(_scanned(spark.sparkContext.broadcast(parts[0]), size, False), HITS)
    for p in parts[1:]:
        out = out.unionByName(base.mapInArrow(_scanned(spark.sparkContext.broadcast(p), size, True), HITS))
    return out.groupBy("rid", "doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("char_starts")).alias("char_starts"), F.flatten(F.collect_list("char_ends")).alias("char_ends"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = find_hits(docs, benchmark, **names)
    n_hit = F.aggregate(F.arrays_zip("starts", "ends"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["ends"] - F.greatest(x["starts"], s["to"]))).cast("long").alias("n"), F.greatest(s["to"], x["ends"]).alias("to")))["n"]
    ordered = hits.select("doc_id", "n_words", F.size("items").cast("long").alias("n_items"), "items", F.array_sort(F.arrays_zip("starts", "ends")).alias("runs"))
    ordered = ordered.select("doc_id", "n_words", "n_items", "items", F.col("runs.starts").alias("starts"), F.col("runs.ends").alias("ends"))
    return ordered.select("doc_id", "n_words", n_hit.alias("n_hit"), "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def contaminated_column(text: Column, spark: SparkSession, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> Column:
    """Whether each text has a hit, by vectorised UDFs (one a share of the benchmark); adds no shuffle, and columns beside it stay."""
    raw, out = F.coalesce(text.cast("string"), F.lit("")), F.lit(False)
    for part in shares(benchmark, item_col, item_text):
        out = out | _hit(spark.sparkContext.broadcast(part), size)(raw)
    return out


def _hit(share, size: int):
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        scanner = scanner_of(share, size)
        return pd.Series([bool(scanner.scan(t.encode())[1]) for t in texts], dtype=bool)

    return run


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op3_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
     k AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0),
     wins AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS win FROM k),
     spots AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM wins)),
     hits AS (SELECT rid, p, n, item_id FROM (SELECT rid, p, n, array_to_string(w[p : p + n - 1], ' ') AS win FROM spots) JOIN wins USING (n, win)),
     words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hits) GROUP BY rid),
     items AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""
}
