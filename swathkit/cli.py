"""Command line: update, query and dump a catalogue; and the cells of a place.

    python -m swathkit update <folder> <list>
    python -m swathkit query <folder> [startTime T] [endTime T] [wkt POLYGON] [insitu FILE]
    python -m swathkit dump <folder> [<list>]
    python -m swathkit cells <longitude> <latitude>

Results go to standard output, one path a line; a point file sets a time difference of three hours.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from swathkit.functions.cells import ids_of_place
from swathkit.operators.catalog import Catalog
from swathkit.plans.search import Search
from swathkit.sources.points import records

HOURS_3 = 3 * 3_600_000


def build_search(spark: SparkSession, words: list[str]) -> Search:
    if len(words) % 2:
        raise ValueError("query arguments come in pairs")
    given = dict(zip(words[::2], words[1::2], strict=True))
    if unknown := set(given) - {"startTime", "endTime", "wkt", "insitu"}:
        raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
    what = Search("cli")
    if "startTime" in given or "endTime" in given:
        what = what.with_dates(given.get("startTime"), given.get("endTime"))
    if "wkt" in given:
        what = what.with_region(given["wkt"])
    if "insitu" in given:
        what = what.with_point_table(records(spark, given["insitu"])).with_delta(HOURS_3)
    return what


def dump_to_file(catalog: Catalog, path: str) -> None:
    """All products as one list file: written in parts, in order, which are then joined."""
    parts, files = f"{path}.parts", catalog.files
    catalog.dump().write.mode("overwrite").text(parts)
    files.concat([f"{parts}/{n}" for n in files.names(parts, "part-")], path)
    files.delete(parts)


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if len(args) < 2 or args[0] not in ("update", "query", "dump", "cells"):
        print(__doc__, file=sys.stderr)
        return 1
    if args[0] == "cells":
        if len(args) != 3:
            print(__doc__, file=sys.stderr)
            return 1
        for level, cell, short in ids_of_place(float(args[1]), float(args[2])):
            print(level, cell, short)
        return 0
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    catalog = Catalog(spark, args[1])
    try:
        if args[0] == "update":
            print(catalog.update(args[2:]))
        elif args[0] == "query":
            for row in catalog.query(build_search(spark, args[2:])).toLocalIterator():
                print(row[0])
        elif len(args) > 2:
            dump_to_file(catalog, args[2])
        else:
            for row in catalog.dump().toLocalIterator():
                print(row[0])
    except ValueError as e:
        print(e, __doc__, sep="\n", file=sys.stderr)
        return 1
    return 0
