"""Files through Hadoop's file systems, so that catalogues live wherever Spark reads; and the place of a text file's lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_BITS = 44  # of a line's place: a file's bytes; above, the file's number


def numbered_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """line, file_no, seq: lines of the files in the order given, those of a folder by name; seq is unique and ascends.

    Within a file, a line's place is the start of its block and its number in the task; a task that has a whole block of a
    file has no other, so no place is taken twice. The driver holds the names of the files.
    """
    if not paths:
        return spark.createDataFrame([], "line string, file_no int, seq long")
    plain = lambda name: name.replace("///", "/", 1)
    names = dict.fromkeys(plain(f) for path in dict.fromkeys(paths) for f in sorted(spark.read.text(path).inputFiles()))
    files = F.broadcast(spark.createDataFrame([(f, k) for k, f in enumerate(names)], "file string, file_no int"))
    at = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    raw = spark.read.text(list(dict.fromkeys(paths))).select(F.col("value").alias("line"), F.regexp_replace("_metadata.file_path", "///", "/").alias("file"), at.alias("at"))
    return raw.join(files, "file").select("line", "file_no", (F.shiftleft(F.col("file_no").cast("long"), FILE_BITS) + F.col("at")).alias("seq"))


class Files:
    """Whole-file operations on one catalogue's folder or any path."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, folder: str, prefix: str = "") -> list[str]:
        """Names in a folder that start with prefix, sorted; none if there is no folder."""
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        if fs.exists(p) and not fs.delete(p, True):
            raise OSError(f"not deleted: {path}")

    def rename(self, path: str, to: str) -> None:
        fs, p = self._at(path)
        _, q = self._at(to)
        fs.mkdirs(q.getParent())
        if not fs.rename(p, q):
            raise OSError(f"not renamed: {path} to {to}")

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, path: str, content: bytes) -> None:
        """Replace a small file: written beside it, then renamed over it in one step where the file system can."""
        fs, p = self._at(path)
        _, beside = self._at(f"{path}.tmp")
        fs.mkdirs(p.getParent())
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        over = gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(beside), fs.makeQualified(p), over)

    def concat(self, paths: list[str], to: str) -> None:
        """One file of the others' bytes, copied on the JVM's side in blocks."""
        fs, p = self._at(to)
        fs.mkdirs(p.getParent())
        out = fs.create(p, True)
        try:
            for path in paths:
                own, q = self._at(path)
                stream = own.open(q)
                try:
                    self.spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
                finally:
                    stream.close()
        finally:
            out.close()
