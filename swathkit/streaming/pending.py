"""Pending product lists as a stream: each new list in a folder is merged into a catalogue once.

The stream reads lines with Structured Streaming's file source; each micro-batch is parsed by the batch reader's own parser
and inserted with the catalogue's own insert, so a path that arrives twice is added once. As in a batch read, a line of fewer
than four fields fails the query, and a line with a bad time adds nothing: such lines go to the catalogue's folder bad_lines/,
one file set a micro-batch. An empty line is skipped; it does not end its file, as a stream has no files. The checkpoint makes a
restart go on where it stopped; a batch that runs twice inserts nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from swathkit.operators.catalog import Catalog
from swathkit.sources.products import bad_time, fields, from_fields, in_minutes

BAD = "bad_lines"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Product rows of a stream's or a batch's lines (column value)."""
    rows = fields(lines.select(F.col("value").alias("line")))
    return in_minutes(from_fields(rows, F.monotonically_increasing_id()))


def ingest(spark: SparkSession, folder: str, catalog: Catalog, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start merging lists that appear in a folder; once: stop when all that are there are merged."""
    lines = spark.readStream.text(folder)

    def merge(batch: DataFrame, number: int) -> None:
        bad = fields(batch.select(F.col("value").alias("line"))).filter(bad_time()).select("line")
        if not bad.isEmpty():
            bad.write.mode("overwrite").text(f"{catalog.folder}/{BAD}/{number}")
        catalog.insert(parse_lines(batch))

    writer = lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
