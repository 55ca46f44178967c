"""Exact dedup by a log-structured merge index of text digests.

Documents are digested once and go to the index in batches. In a batch each task pre-aggregates its digests in memory (the
memtable); the merged result is flushed as one run: a Parquet folder sorted by digest within its files, with a filter (a
bitmap of digests' hashes). Every `fanout` runs of a level are compacted to one of the next level, which keeps the smallest
identifier and sums counts; the runs before are deleted. At the end, a digest of one run goes to the last merge only if
another run's filter may have it; all others are settled where they are. Digests that occur more than once are hits: only
their documents' rows are joined, and their texts are grouped by their bytes, which proves equality or splits a collision.

Defined results: a null text is an empty text, so null and empty texts form one group. A null doc_id sorts after all
others. Of repeated rows (same doc_id, same text) one stays. An empty table gives an empty result. Extra columns are
ignored. Texts of any length, very long ones too, are hashed and compared whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.llm.common import MAX_BITMAP_BITS, documents, drop, filter_bits, filter_blocks, prepare, presence_filter, read_back, scratch, skew_join, table, with_presence, written

MEMTABLE_ROWS, LEAST_BATCHES = 1 << 26, 5  # documents of a flush at most, and flushes at least
SPACES = r"[\x20\x09-\x0D]+"


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def text_digest(text: Column) -> Column:
    """SHA-256 of a text with each run of white space as one space; a null text is empty."""
    return sha256_of(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " "))


def hash_long(digest: Column) -> Column:
    return F.xxhash64(digest)


@dataclass
class Run:
    """Sorted digests (digest, first, n) and their filter of so many bits."""

    rows: DataFrame
    blocks: DataFrame
    bits: int


class DigestIndex:
    """Runs by level; first is the smallest identifier of a digest, a struct(no_id, doc_id, rid)."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.compactions = spark, fanout, 0
        self.levels: list[list[Run]] = [[]]

    @property
    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def _merged(df: DataFrame) -> DataFrame:
        return df.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))

    @staticmethod
    def _union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def _flushed(self, df: DataFrame) -> Run:
        path = scratch(self.spark, "digest-run")
        df.sortWithinPartitions("digest").write.option("compression", "zstd").parquet(path)
        rows = read_back(df, path)
        bits = filter_bits(rows.count())
        return Run(rows, written(filter_blocks(rows, hash_long(F.col("digest")), bits), "digest-filter"), bits)

    def append(self, rows: DataFrame) -> None:
        """Flush a batch of (digest, doc_id, rid) as a run of level 0, and compact full levels."""
        self.levels[0].append(self._flushed(rows.groupBy("digest").agg(F.min(identifier()).alias("first"), F.count("*").alias("n"))))
        k = 0
        while len(self.levels[k]) >= self.fanout:
            full = self.levels[k]
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._flushed(self._merged(self._union([r.rows for r in full]))))
            self.levels[k] = []
            self.compactions += 1
            drop(*[t for r in full for t in (r.rows, r.blocks)])
            k += 1

    def hits(self) -> DataFrame:
        """(digest, first, n) of digests with more than one row in all runs together.

        A run's digests that no other run's filter has are settled alone; the rest is merged. A filter that is too large to
        broadcast counts as having every digest.
        """
        runs, alone, shared = self.runs, [], []
        for run in runs:
            rows, names = run.rows, []
            for k, other in enumerate(runs):
                if other is not run:
                    names.append(f"_in{k}")
                    rows = with_presence(rows, hash_long(F.col("digest")), other.blocks, other.bits, names[-1]) if other.bits <= MAX_BITMAP_BITS else rows.withColumn(names[-1], F.lit(True))
            elsewhere = F.greatest(*names, F.lit(False)) if names else F.lit(False)
            flagged = rows.withColumn("_elsewhere", elsewhere).drop(*names)
            alone.append(flagged.filter("not _elsewhere").drop("_elsewhere"))
            shared.append(flagged.filter("_elsewhere").drop("_elsewhere"))
        return self._union([*alone, self._merged(self._union(shared))]).filter("n > 1") if len(runs) > 1 else alone[0].filter("n > 1")


def identifier() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")


def batches_of_rows(rows: DataFrame, batches: int | None) -> list[DataFrame]:
    """rows, whose rid has the partition above 33 bits, in batches: by partitions, which Parquet's statistics tell apart, or else by rid."""
    n, last = rows.agg(F.count("*"), F.max(F.shiftright("rid", 33))).first()
    batches = batches or max(LEAST_BATCHES, -(-n // MEMTABLE_ROWS))
    parts = (last or 0) + 1
    if parts < batches:
        return [rows.filter(F.pmod("rid", F.lit(batches)) == k) for k in range(batches)]
    edge = [(parts * k // batches) << 33 for k in range(batches + 1)]
    return [rows.filter((F.col("rid") >= a) & (F.col("rid") < b)) for a, b in zip(edge, edge[1:], strict=False)]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_of, batches: int | None = None, text_hash: bool = False, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (see the module for edge cases).

    digest: text -> binary; only tests replace it, to see that colliding texts are told apart. batches: into how many
    memtable flushes the rows go, if not by MEMTABLE_ROWS. text_hash: adds the xxhash64 of the text as it is. index: an
    empty index to use.
    """
    spark = prepare(docs.sparkSession)
    norm = documents(docs, id_col, text_col).select("doc_id", F.regexp_replace("text", SPACES, " ").alias("text"), F.xxhash64("text").alias("text_hash"))
    rows = written(norm.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *["text_hash"] * text_hash, digest(F.col("text")).alias("digest"), sha256_of(F.col("text")).alias("sha")), "digests")
    index = index or DigestIndex(spark)
    for batch in batches_of_rows(rows, batches):
        index.append(batch.select("digest", "doc_id", "rid"))
    hits = written(index.hits(), "digest-hits")
    drop(*[t for r in index.runs for t in (r.rows, r.blocks)])
    n_hits, total = hits.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    own = F.coalesce("first.rid", "rid") == F.col("rid")
    keep = F.when(own, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    out = lambda df: df.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), own.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *["text_hash"] * text_hash)
    none = lambda df: df.withColumns({"first": F.lit(None).cast(hits.schema["first"].dataType), "n": F.lit(None).cast("long")})
    if not n_hits:
        return out(none(rows))
    # Byte verification: texts of hit digests are grouped by their bytes; copies within a task meet before the shuffle.
    at, key = hash_long(F.col("digest")), hash_long(F.col("digest"))
    suspects = presence_filter(norm.withColumn("digest", digest(F.col("text"))), at, hits, key, n_hits)
    texts = suspects.groupBy("digest", "text").agg(F.count("*").alias("copies"))
    split = written(texts.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").join(hits.select("digest"), "digest", "left_semi"), "collisions")
    # Rows that the filter of hits does not have are single, without a join.
    bits = min(filter_bits(n_hits), MAX_BITMAP_BITS)
    flagged = with_presence(rows, at, filter_blocks(hits, key, bits), bits, "_may")
    single = out(none(flagged.filter("not _may").drop("_may")))
    found = skew_join(flagged.filter("_may").drop("_may"), hits, "digest", "n", total, "left")
    if split.isEmpty():
        return single.unionByName(out(found))
    # Digests with several texts: the same by the full digest of the text, checked to be as many as there are texts.
    apart = found.join(split, "digest").drop("first", "n")
    by_sha = apart.groupBy("digest", "sha").agg(F.min(identifier()).alias("first"), F.count("*").alias("n"))
    wrong = by_sha.groupBy("digest").count().join(split, "digest").filter("count != texts")
    if not wrong.isEmpty():
        raise ValueError("different texts share their SHA-256")
    return single.unionByName(out(found.join(split, "digest", "left_anti"))).unionByName(out(apart.drop("texts").join(by_sha, ["digest", "sha"])))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (t)"""
}
