"""Packing along a space-filling curve.

Each document's ids give a hashed vector: every id has a fixed pseudo-random direction in DIMS dimensions, and the
document's is their mean, scaled to unit length. Its grid cell of BITS bits a dimension has a Hilbert key. Documents are
range-sorted by (key, doc_id) and their ids laid end to end; the line is cut every `size` ids, so neighbours on the curve
share sequences. What is left at the end is cut into powers of two, which need no padding; so there is no padding at all.

Ids are computed once and written to the shared folder; only (row, key, length) is range-sorted, and running sums by
partition give each document its place on the line. Copies that share a key are told apart by doc_id and row, so no key
is a hot one.

Defined results: a null or empty text has only the end id; its vector is zero. Null doc_ids sort first within a key. Each
of several rows with a doc_id is a document by itself. Very long texts are encoded
whole and cut freely. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark import TaskContext

from swathkit.llm.common import batches_of, documents, partitions, prepare, table, written
from swathkit.llm.tokens import encoder, vocabulary

SIZE, END_ID, DIMS, BITS, SEED = 2048, 1, 4, 8, 20240501
PLACES, LEAST_PARTS = 1 << 20, 8  # rows (of 32 bytes) that a partition of the curve has at most, and partitions at least


def directions(n_ids: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, n_ids)).astype(np.float32)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indices of cells (rows of coordinates of that many bits), by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        p = (1 << b) - 1
        for i in range(n):
            high = (x[i] >> b & 1).astype(bool)
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            if i:
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        t ^= np.where(x[n - 1] >> b & 1, (1 << b) - 1, 0)
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


def direction(ids: np.ndarray, table: np.ndarray) -> list[float]:
    """The sum of the ids' directions; table has a row a dimension."""
    return [float(t[ids].sum(dtype=np.float64)) for t in table]


def curve_keys(sums: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of the unit vectors along these sums (zero stays zero)."""
    v = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
    return hilbert_keys(np.minimum(((v + 1) / 2 * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def cuts(total: int, size: int = SIZE) -> tuple[int, list[int]]:
    """Number of full sequences, and the starts of the shorter ones after them."""
    full, rest = divmod(total, size)
    at, out = full * size, []
    for b in range(rest.bit_length() - 1, -1, -1):
        if rest >> b & 1:
            out.append(at)
            at += 1 << b
    return full, out


def pieces(start: int, n: int, full: int, tail: list[int], size: int = SIZE) -> Iterator[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset) of a document that lies at start on the line."""
    at, end = start, start + n
    while at < end:
        seq = at // size
        if seq < full:
            first, past = seq * size, (seq + 1) * size
        else:
            k = int(np.searchsorted(tail, at, "right")) - 1
            seq, first, past = full + k, tail[k], tail[k + 1] if k + 1 < len(tail) else end
        stop = min(end, past)
        yield at - start, stop - at, seq, at - first
        at = stop


def _encoding(vocab: str, kind: str, dtype: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocab, kind, dtype), np.asarray(end_id, dtype).tobytes()
        table = directions(enc.n_ids)
        rid = TaskContext.get().partitionId() << 33
        for b in batches:
            raw = [enc.encode(t.as_py()) for t in b.column(1)]
            ids = [np.frombuffer(r, dtype) for r in raw]
            keys = curve_keys(np.array([direction(x, table) for x in ids]).reshape(-1, DIMS))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + len(raw))), b.column(0), pa.array(keys), pa.array([len(x) + 1 for x in ids], pa.int64()), pa.array([r + end for r in raw], pa.binary())], names=["rid", "doc_id", "key", "n", "ids"])
            rid += len(raw)

    return run


def _placing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column(1).to_numpy()
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(ends - n), b.column(1)], names=["rid", "part", "local", "n"])
        at = int(ends[-1]) if len(n) else at


def _cutting(dtype: str, total: int, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, tail = cuts(total, size)
        names = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
        schema = pa.schema(names + [("ids", pa.list_(pa.int32()))] * with_ids)

        def rows():
            for b in batches:
                for doc, n, place, raw in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("place").to_pylist(), b.column("ids"), strict=True):
                    ids = np.frombuffer(raw.as_py(), dtype).astype("<u4")
                    for a, length, seq, offset in pieces(place, n, full, tail, size):
                        own = ids[a : a + length]
                        yield (doc, a, length, zlib.crc32(own.tobytes()), n, seq, offset) + ((own.tolist(),) if with_ids else ())

        yield from batches_of(schema, rows())

    return run


def pack(docs: DataFrame, vocab: str, kind: str = "byte", dtype: str = "<u2", size: int = SIZE, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the piece's ids."""
    spark = prepare(docs.sparkSession)
    tokens = written(documents(docs, id_col, text_col).mapInArrow(_encoding(vocab, kind, dtype, end_id), "rid long, doc_id long, key long, n long, ids binary"), "tokens")
    parts = max(min(partitions(spark), LEAST_PARTS), -(-tokens.count() // PLACES))
    order = tokens.select("rid", "key", "doc_id", "n").repartitionByRange(parts, "key", "doc_id", "rid").sortWithinPartitions("key", "doc_id", "rid")
    places = written(order.select("rid", "n").mapInArrow(_placing, "rid long, part long, local long, n long"), "places")
    sums = sorted((r[0], r[1]) for r in places.groupBy("part").agg(F.sum("n")).collect())  # one row a partition
    bases, total = [], 0
    for part, n in sums:
        bases.append((part, total))
        total += n
    base = F.broadcast(spark.createDataFrame(bases, "part long, base long"))
    placed = places.join(base, "part").select("rid", (F.col("base") + F.col("local")).alias("place"))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    # Places are small beside ids: a hash table of a partition's places spares sorting its ids.
    return tokens.drop("key").join(placed.hint("shuffle_hash"), "rid").mapInArrow(_cutting(dtype, total, size, with_ids), out)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of pack(..., with_ids=True): sequence_id, ids, doc_ids; at most `size` ids each."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(own.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
