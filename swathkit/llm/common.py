"""Helpers shared by the text operators: shared-folder tables, skew-safe joins, presence bitmaps."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
HEAVY_KEYS = 1024  # a key is heavy when it holds at least 1/HEAVY_KEYS of the rows: no more than HEAVY_KEYS such keys exist
BITMAP_BITS = 1 << 15  # bits in one bitmap block
MAX_BITMAP_BITS = 1 << 28  # 32 MB: the most that presence_filter() broadcasts
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound the rows of an Arrow batch and of a Parquet reader's (texts can be long)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(ARROW_ROWS))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local masters only) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = Path(tempfile.gettempdir(), "swathkit-checkpoints").as_uri()
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_ROOTS: set[str] = set()
_SCOPES: list[Scope] = []


class Scope:
    """While it is entered, scratch() gives paths in a folder of its own, which delete() removes."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, scratch(spark, name)

    def __enter__(self) -> Scope:
        _SCOPES.append(self)
        return self

    def __exit__(self, *error) -> None:
        _SCOPES.remove(self)

    def delete(self) -> None:
        fs, p = _at(self.spark, self.path)
        fs.delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, which goes when the application ends."""
    root = f"{shared_root(spark)}/swathkit/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        fs, p = _at(spark, root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _ROOTS.add(root)
    return f"{_SCOPES[-1].path if _SCOPES else root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor costs nothing before it."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return read_back(df, path)


def read_back(df: DataFrame, path: str) -> DataFrame:
    """The table that df was written to; drop() knows where it is."""
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop(*tables: DataFrame) -> None:
    """Delete tables made by written() or read_back() that nothing reads any more."""
    for t in tables:
        fs, p = _at(t.sparkSession, t._scratch_path)
        fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), whatever else df has; a null text is empty."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return [next(x for k in range(len(taken) + 1) if (x := "_" * k + n).lower() not in taken) for n in names]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def skew_join(rows: DataFrame, per_key: DataFrame, key: str | list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """Inner or left join of rows with per_key, which has one row a key with the number n of its rows.

    Heavy keys (at least total/HEAVY_KEYS rows, so HEAVY_KEYS keys at most) are broadcast and their rows stay where
    they are; all others are light enough for a shuffle join.
    """
    least = max(total // HEAVY_KEYS, 256)
    heavy = per_key.filter(F.col(n) >= least)
    light = per_key.filter(F.col(n) < least)
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(light, key, how)
    return hot.unionByName(rest)


def filter_bits(n_keys: int) -> int:
    """Bits of a filter of so many keys: 8 a key or more."""
    return max(BITMAP_BITS, 1 << (8 * max(n_keys, 1) - 1).bit_length())


def filter_blocks(keys: DataFrame, key_at: Column, bits: int) -> DataFrame:
    """A filter of keys' hashes (longs) as a table of bitmaps: _block, _bits."""
    pos = F.pmod(key_at, F.lit(bits).cast("long"))
    return keys.groupBy((pos / BITMAP_BITS).cast("long").alias("_block")).agg(F.bitmap_construct_agg(F.pmod(pos, F.lit(BITMAP_BITS).cast("long"))).alias("_bits"))


def with_presence(rows: DataFrame, at: Column, blocks: DataFrame, bits: int, name: str) -> DataFrame:
    """Adds a boolean: whether the hash `at` may be in filter_blocks(..., bits), which is broadcast, so bits is MAX_BITMAP_BITS at most."""
    place, block, off, own = fresh_names(rows, "_at", "_block", "_off", "_bits")
    byte = F.conv(F.hex(F.expr(f"substring(`{own}`, cast(`{off}` div 8 as int) + 1, 1)")), 16, 10).cast("int")
    out = rows.withColumn(place, F.pmod(at, F.lit(bits).cast("long")))
    out = out.withColumns({block: (F.col(place) / BITMAP_BITS).cast("long"), off: F.pmod(place, F.lit(BITMAP_BITS).cast("long"))})
    bit = F.call_function("getbit", byte, F.pmod(off, F.lit(8).cast("long")).cast("int")).cast("int")
    blocks = blocks.select(F.col("_block").alias(block), F.col("_bits").alias(own))
    return out.join(F.broadcast(blocks), block, "left").withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop(place, block, off, own)


def without(rows: DataFrame, hashed: Column, gone: DataFrame, gone_hash: Column, same: Callable[[DataFrame], Column]) -> DataFrame:
    """rows that have no match in gone (a written table without names of rows): same(gone) says which match, and only those of equal hashes can.

    A filter of gone's hashes is broadcast; only the rows that it may have are joined, so the others are not shuffled.
    """
    bits = min(filter_bits(gone.count()), MAX_BITMAP_BITS)
    (may,) = fresh_names(rows, "_may")
    flagged = with_presence(rows, hashed, filter_blocks(gone, gone_hash, bits), bits, may)
    stay, rest = flagged.filter(~F.col(may)).drop(may), flagged.filter(may).drop(may)
    return stay.unionByName(rest.join(gone, same(gone), "left_anti"))


def presence_filter(rows: DataFrame, at: Column, keys: DataFrame, key_at: Column, n_keys: int) -> DataFrame:
    """rows whose hash `at` may be among keys' hashes `key_at` (both longs); some others pass too.

    The broadcast side is a bitmap of 8 bits a key, at most MAX_BITMAP_BITS: beyond that more rows pass, none is lost.
    """
    bits = min(filter_bits(n_keys), MAX_BITMAP_BITS)
    return with_presence(rows, at, filter_blocks(keys, key_at, bits), bits, "_may").filter("_may").drop("_may")


def bitmap(keys: DataFrame, at: Column, n_keys: int, bits_each: int = 32) -> np.ndarray:
    """The bits of keys' hashes `at` (non-negative longs), on the driver: bits_each bits a key, at most MAX_BITMAP_BITS (32 MB)."""
    bits = min(max(BITMAP_BITS, 1 << (bits_each * max(n_keys, 1) - 1).bit_length()), MAX_BITMAP_BITS)
    pos = F.pmod(at, F.lit(bits).cast("long"))
    rows = keys.groupBy((pos / BITMAP_BITS).cast("long").alias("b")).agg(F.bitmap_construct_agg(F.pmod(pos, F.lit(BITMAP_BITS).cast("long"))).alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for b, m in rows:
        out[b * BITMAP_BITS // 8 : (b + 1) * BITMAP_BITS // 8] = np.frombuffer(bytes(m), np.uint8)
    return out


def in_bitmap(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the hashes `at` may be in bitmap()'s keys."""
    pos = at % (8 * len(bits))
    return (bits[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1


def batches_of(schema: pa.Schema, rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
