"""Product lists: tab-separated text of path, start, end and a WKT footprint, without a header; and dumps in that form.

Read natively, in parallel, with the line order kept in ingest_seq (unique, ascending within and across the given files).
A missing start or end is copied from the other; "null" and empty are no time. An empty line ends its file if
stop_at_blank (the default). Fewer than four fields fail the read; a line with a bad time is skipped and can be had from
bad_lines(). The -1 that stands for "none" elsewhere is NULL here, so the instant one millisecond before 1970 is a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.functions.times import end_minute, minute_text, parsed, start_minute
from swathkit.sources.files import numbered_lines

COLUMNS = ["path", "start_min", "end_min", "wkt", "ingest_seq"]


def lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """line, file_no, seq: lines of files in the order given."""
    return numbered_lines(spark, paths)


def fields(raw: DataFrame, live: Column | None = None) -> DataFrame:
    """Adds f, the fields of the lines that count (live, and not empty).

    Fewer than four fields fail the read. The check asks itself whether the line counts, as filters may be reordered. A
    generator gives f, so that a line is split once, and not wherever a later filter or column uses a field.
    """
    live = F.col("line") != "" if live is None else live & (F.col("line") != "")
    f = F.split("line", "\t", -1)
    checked = F.when(live & (F.size(f) < 4), F.raise_error(F.concat(F.lit("fewer than four fields: "), F.col("line")))).otherwise(f)
    return raw.select("*", F.explode(F.array(checked)).alias("f")).filter(live)


def _fields(raw: DataFrame, stop_at_blank: bool) -> DataFrame:
    if not stop_at_blank:
        return fields(raw)
    end = raw.filter(F.col("line") == "").groupBy("file_no").agg(F.min("seq").alias("stop"))  # a row a file
    return fields(raw.join(F.broadcast(end), "file_no", "left"), F.col("stop").isNull() | (F.col("seq") < F.col("stop")))


def _bad(field: Column) -> Column:
    text = F.trim(field)
    return (text != "") & (F.lower(text) != "null") & parsed(field).isNull()


def bad_time() -> Column:
    """Whether a line with fields f has a time that is none."""
    return _bad(F.col("f")[1]) | _bad(F.col("f")[2])


def repaired(start: Column, end: Column) -> tuple[Column, Column]:
    """Each time, or the other if it is missing."""
    return F.coalesce(start, end), F.coalesce(end, start)


def from_fields(rows: DataFrame, seq: Column) -> DataFrame:
    """path, start_ms, end_ms, wkt, ingest_seq of rows with fields f; those with a bad time are left out."""
    f = F.col("f")
    start, end = repaired(parsed(f[1]), parsed(f[2]))
    return rows.filter(~bad_time()).select(f[0].alias("path"), start.alias("start_ms"), end.alias("end_ms"), f[3].alias("wkt"), seq.alias("ingest_seq"))


def read_products(spark: SparkSession, paths: str | Sequence[str], stop_at_blank: bool = True) -> DataFrame:
    """path, start_ms, end_ms, wkt, ingest_seq; lines with a bad time are left out."""
    return from_fields(_fields(lines(spark, [paths] if isinstance(paths, str) else paths), stop_at_blank), F.col("seq"))


def bad_lines(spark: SparkSession, paths: str | Sequence[str], stop_at_blank: bool = True) -> DataFrame:
    return _fields(lines(spark, [paths] if isinstance(paths, str) else paths), stop_at_blank).filter(bad_time()).select("line", "file_no")


def in_minutes(products: DataFrame) -> DataFrame:
    """The catalogue form: start down, end up, to minutes."""
    return products.select("path", start_minute(F.col("start_ms")).alias("start_min"), end_minute(F.col("end_ms")).alias("end_min"), "wkt", "ingest_seq")


def dump_line() -> Column:
    """A product's path, start, end and WKT, tab-separated; "null" for no time."""
    return F.concat_ws("\t", "path", minute_text(F.col("start_min")), minute_text(F.col("end_min")), "wkt")


def dump_lines(products: DataFrame) -> DataFrame:
    """One text column `value`, as dump_line() has it."""
    return products.select(dump_line().alias("value"))


def write_dump(products: DataFrame, path: str) -> None:
    """Lines in start order, as text files in a folder."""
    dump_lines(products.orderBy(F.asc_nulls_first("start_min"), "ingest_seq")).write.mode("overwrite").text(path)
