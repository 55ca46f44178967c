"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames of FRAME_BYTES of ids or a little more, a skippable frame with the index
(doc_id and number of ids of each document, as an Arrow stream), and the trailing seek table of the public "zstd seekable
format": for each frame its compressed size, its size, and the low 32 bits of the XXH64 of its content. A reader fetches the
tail, finds the frames that overlap a document's bytes, decompresses only these and checks each.

Files are written by executors into the shared folder through pyarrow's file systems, under a name of the attempt's own; the
manifest, a Parquet table committed by Spark, lists those of successful tasks, so a lost executor leaves no half file in it.
Documents are range-partitioned by doc_id before they are encoded, so files are in doc_id order.

Defined results: a null or empty text has only the end id. A null doc_id sorts first and stays null. Rows that repeat a
doc_id follow each other (by a hash of the text). An empty table gives no files and an empty result. Long documents span
frames. Extra columns are ignored.
"""

from __future__ import annotations

import contextlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark import TaskContext

from swathkit.llm.common import batches_of, documents, partitions, prepare, scratch, table, written
from swathkit.llm.tokens import encoder, vocabulary

FRAME_BYTES = 1 << 18
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
END_ID = 2


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Writer:
    """Appends documents' ids to an open binary file."""

    def __init__(self, out, dtype: str, frame_bytes: int = FRAME_BYTES):
        self.out, self.dtype, self.frame_bytes = out, dtype, frame_bytes
        self.held: list[bytes] = []
        self.size, self.docs, self.lengths, self.frames = 0, [], [], []
        self.pack = zstandard.ZstdCompressor(level=3, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // np.dtype(self.dtype).itemsize)
        for k in range(0, len(ids), self.frame_bytes):
            piece = ids[k : k + self.frame_bytes]
            self.held.append(piece)
            self.size += len(piece)
            if self.size >= self.frame_bytes:
                self._flush()

    def _flush(self) -> None:
        data = b"".join(self.held)
        frame = self.pack.compress(data)
        self.out.write(frame)
        self.frames.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        sink = io.BytesIO()
        index = pa.table({"doc_id": pa.array(self.docs, pa.int64()), "n_ids": pa.array(self.lengths, pa.int64())}).replace_schema_metadata({"dtype": self.dtype})
        with pa.ipc.new_stream(sink, index.schema) as s:
            s.write_table(index)
        body = self.pack.compress(sink.getvalue())
        self.out.write(struct.pack("<III", INDEX_MAGIC, len(body) + 4, zlib.crc32(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class Reader:
    """Reads single documents of a file; frames_read counts the frames decompressed."""

    def __init__(self, source):
        self.source, size = source, source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        head = size - 9 - 12 * n - 8
        raw = self._at(head, 8 + 12 * n)
        if struct.unpack("<II", raw[:8]) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(raw[8:], "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        magic, length, crc = struct.unpack("<III", self._at(int(self.at[-1]), 12))
        body = self._at(int(self.at[-1]) + 12, length - 4)
        if magic != INDEX_MAGIC or zlib.crc32(body) != crc:
            raise ValueError("the index is damaged")
        index = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_all()
        self.dtype = np.dtype(index.schema.metadata[b"dtype"].decode())
        self.doc_ids, self.n_ids = index["doc_id"].to_pylist(), index["n_ids"].to_numpy()
        self.first = np.concatenate([[0], np.cumsum(self.n_ids)])
        self.frames_read, self._last = 0, (-1, b"")

    def _at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            data = zstandard.ZstdDecompressor().decompress(self._at(int(self.at[k]), int(self.frames[k, 0])))
            if len(data) != self.frames[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.frames_read += 1
            self._last = (k, data)
        return self._last[1]

    def ids(self, row: int) -> np.ndarray:
        """The ids of the document in this row of the index."""
        w = self.dtype.itemsize
        a, b = int(self.first[row]) * w, int(self.first[row + 1]) * w
        out = []
        k = int(np.searchsorted(self.starts, a, "right")) - 1
        while a < b:
            data, at = self.frame(k), a - int(self.starts[k])
            out.append(data[at : at + b - a])
            a += len(out[-1])
            k += 1
        return np.frombuffer(b"".join(out), self.dtype)


def _writing(path: str, vocab: str, kind: str, dtype: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(path)
        enc, end = encoder(vocab, kind, dtype), np.asarray(end_id, dtype).tobytes()
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
        writer = None
        with contextlib.ExitStack() as open_files:  # closes the file of a task that fails, too
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if writer is None:
                        fs.create_dir(folder, recursive=True)
                        writer = Writer(open_files.enter_context(fs.open_output_stream(f"{folder}/{name}", compression=None)), dtype)
                    writer.add(doc, enc.encode(text.as_py()) + end)
            if writer:
                writer.close()
        if writer:
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([part], pa.int64()), "file": [name], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([sum(writer.lengths)], pa.int64())})

    return run


def write_store(docs: DataFrame, path: str, vocab: str, kind: str = "word", dtype: str = "<u2", end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of docs under path in ascending doc_id order; returns the manifest: file_no, file, n_docs, n_ids."""
    spark = prepare(docs.sparkSession)
    ordered = documents(docs, id_col, text_col).withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = ordered.select("doc_id", "text").mapInArrow(_writing(path, vocab, kind, dtype, end_id), "file_no long, file string, n_docs long, n_ids long")
    return written(rows, "manifest")


def _reading(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(path)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

        def rows():
            for b in batches:
                for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                    with fs.open_input_file(f"{folder}/{name}") as f:
                        reader = Reader(f)
                        for k, doc in enumerate(reader.doc_ids):
                            ids = reader.ids(k)
                            yield doc, base + int(reader.first[k]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())

        yield from batches_of(schema, rows())

    return run


def read_store(path: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. The window runs over one row a file."""
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("base", before).select("file", "base").repartition(partitions(manifest.sparkSession), "file")
    return files.mapInArrow(_reading(path), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch(spark, "token-store")
    return read_store(path, write_store(docs, path, vocabulary("word_bpe_49k.json")))
