"""Catalogues: versioned Parquet tables of products with safe updates, pending lists, an archive, and dumps.

A catalogue is a folder: parts v<n>/ (products in start order: path, start_min, end_min, wkt, ingest_seq, cells, bounds), each
with the settings of version n in v<n>/_version.json; a pointer file _current with those of the version in use; pending lists
scan.*; and attic/. A version is a list of parts. An update writes what is new as a part; every MAX_PARTS parts it writes all
as one. Then it replaces the pointer in one step, so a crash leaves the old version in use and its leftover is overwritten.
If the pointer cannot be read, the newest complete version is used. The parts of the two newest versions are kept. Products
whose path is known are not added again, and of several new ones the first in reading order wins. The level of cells is the
catalogue's own: it is set by its first version and read from there.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.functions import cells as C
from swathkit.functions.sphere import BOUNDS
from swathkit.functions.times import stamp
from swathkit.plans.search import UNLIMITED, Search, ordered, search, unordered
from swathkit.sources.files import Files
from swathkit.sources.products import dump_lines, in_minutes, read_products

FORMAT, POINTER, ATTIC, SETTINGS, MAX_PARTS = 2, "_current", "attic", "_version.json", 8
SCHEMA = "path string, start_min int, end_min int, wkt string, ingest_seq long, cells array<int>, lat_lo double, lat_hi double, lng_lo double, lng_hi double"


def first_by_path(new: DataFrame) -> DataFrame:
    """Of rows that share a path, the first by ingest_seq. Few share one: rows are brought together before they are sorted, not after, too."""
    best = F.min_by(F.struct(*new.columns), "ingest_seq")
    return new.repartition("path").groupBy("path").agg(best.alias("r")).select("r.*")


def only_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """Those of new whose path old does not have, one a path; they follow old ones in ingest_seq."""
    last = old.agg(F.coalesce(F.max("ingest_seq"), F.lit(-1)).alias("m")).scalar()
    return first_by_path(new).join(old.select("path"), "path", "left_anti").withColumn("ingest_seq", F.col("ingest_seq") + last + 1)


def insert_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and those of new whose path old does not have; new rows follow old ones in ingest_seq."""
    return old.unionByName(only_new(old, new).select(*old.columns))


def with_geometry(products: DataFrame, level: int = C.DEFAULT_LEVEL) -> DataFrame:
    """Adds the cells that cover each footprint, and its bounds."""
    g = products.withColumn("g", C.wkt_geometry(F.col("wkt"), level))
    return g.select(*products.columns, "g.cells", *[f"g.{n}" for n in BOUNDS])


def interned(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct coverings with ids, and products with coverage_id in place of cells."""
    coverages = products.select("cells").distinct().withColumn("coverage_id", F.xxhash64("cells"))
    return coverages, products.withColumn("coverage_id", F.xxhash64("cells")).drop("cells")


class Catalog:
    """A catalogue in one folder."""

    def __init__(self, spark: SparkSession, folder: str, level: int | None = None, use_index: bool = True, pending_prefix: str = "scan.", fail_if_missing: bool = False, keep: int = 2, archive: bool = True, verbose: bool = False):
        self.spark, self.folder, self.own_level, self.use_index = spark, folder.rstrip("/"), level, use_index
        self.pending_prefix, self.fail_if_missing, self.keep, self.archive_lists, self.verbose = pending_prefix, fail_if_missing, keep, archive, verbose
        self.files, self.closed = Files(spark), False

    def __enter__(self) -> Catalog:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        """Searches and updates are errors from now on."""
        self.closed = True

    def _check_open(self) -> None:
        if self.closed:
            raise RuntimeError(f"the catalogue in {self.folder} is closed")

    def _say(self, text: str) -> None:
        if self.verbose:
            print(text)

    def _settings(self, at: str) -> dict | None:
        """Settings in a file; None if there is none, or if it is cut off."""
        if not self.files.exists(at):
            return None
        try:
            meta = json.loads(self.files.read(at))
        except ValueError:
            return None
        if not isinstance(meta, dict) or meta.get("format") != FORMAT:
            raise ValueError(f"{at}: format {meta.get('format') if isinstance(meta, dict) else meta}, not {FORMAT}")
        return meta

    def _versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self.files.names(self.folder, "v") if n[1:].isdigit())

    def _pointer(self) -> dict | None:
        """Settings of the version in use; None for no catalogue."""
        at = f"{self.folder}/{POINTER}"
        if not self.files.exists(at) and not self.files.exists(f"{at}.tmp"):
            return None
        meta = self._settings(at)
        if meta is None:
            for n in reversed(self._versions()):
                if self.files.exists(f"{self.folder}/v{n}/_SUCCESS") and (meta := self._settings(f"{self.folder}/v{n}/{SETTINGS}")):
                    warnings.warn(f"{at} cannot be read; version {n} is used", stacklevel=3)
                    break
        return meta

    @property
    def version(self) -> int:
        """Number of the version in use; 0 for none."""
        meta = self._pointer()
        return meta["version"] if meta else 0

    @property
    def level(self) -> int:
        """The level of cells: the catalogue's, or what its first version will have."""
        meta = self._pointer()
        return meta["level"] if meta else self.own_level or C.DEFAULT_LEVEL

    def products(self) -> DataFrame:
        """The version in use; empty, or FileNotFoundError if fail_if_missing, without one."""
        self._check_open()
        meta = self._pointer()
        if meta is None:
            if self.fail_if_missing:
                raise FileNotFoundError(f"no catalogue in {self.folder}")
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/v{n}" for n in meta["parts"]])

    def size(self) -> int:
        return self.products().count()

    def pending(self) -> list[str]:
        return [f"{self.folder}/{n}" for n in self.files.names(self.folder, self.pending_prefix)]

    def update(self, lists: Sequence[str] = ()) -> int:
        """Add the products of lists (none given: the pending ones); returns the number read, known paths included.

        The lists then go to the attic, also if nothing was new.
        """
        own = not lists
        lists = list(lists) or self.pending()
        if not lists:
            return 0
        new = in_minutes(read_products(self.spark, lists))
        n = new.count()
        self.insert(new)
        if own or self.archive_lists:
            self.archive(lists)
        self._say(f"{n} products read from {len(lists)} lists")
        return n

    def insert(self, new: DataFrame) -> int:
        """Add product rows (as in_minutes gives them) whose path is not known as a new version; returns the version in use."""
        old, meta = self.products(), self._pointer() or {"version": 0, "parts": [], "level": self.level}
        if self.own_level not in (None, meta["level"]):
            raise ValueError(f"the catalogue in {self.folder} has cells of level {meta['level']}, not {self.own_level}")
        version = meta["version"] + 1
        path = f"{self.folder}/v{version}"
        self._write(only_new(old, new), path, meta["level"])
        if self.spark.read.schema(SCHEMA).parquet(path).isEmpty() and meta["parts"]:
            self.files.delete(path)
            return meta["version"]
        parts = [*meta["parts"], version]
        if len(parts) > MAX_PARTS:
            whole = f"{self.folder}/v{version + 1}"
            self._write(old.unionByName(self.spark.read.schema(SCHEMA).parquet(path)), whole)
            self.files.delete(path)
            version, parts = version + 1, [version + 1]
        own = {"format": FORMAT, "version": version, "level": meta["level"], "parts": parts}
        before = [v for v in self._versions() if v < version][-max(self.keep - 1, 0) :] if self.keep > 1 else []
        needed = {*parts, *[p for v in before for p in (self._settings(f"{self.folder}/v{v}/{SETTINGS}") or {"parts": []})["parts"]]}
        self.files.write(f"{self.folder}/v{version}/{SETTINGS}", json.dumps(own).encode())
        self.files.write(f"{self.folder}/{POINTER}", json.dumps(own).encode())
        for n in self._versions():
            if n not in needed and n < version:
                self.files.delete(f"{self.folder}/v{n}")
        return version

    def _write(self, products: DataFrame, path: str, level: int | None = None) -> None:
        """Products in start order; with a level, their geometry is added once they are in place.

        The bounds of ranges come from a job of their own, which runs what is before it: geometry comes after, so that it is
        computed once, and is not sorted.
        """
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows = products.repartitionByRange(parts, F.asc_nulls_first("start_min"), "ingest_seq").sortWithinPartitions(F.asc_nulls_first("start_min"), "ingest_seq")
        (rows if level is None else with_geometry(rows, level)).select(*names).write.mode("overwrite").parquet(path)

    def archive(self, lists: Sequence[str], suffix: str = ".csv") -> str:
        """Join lists to one file in the attic and delete them."""
        to = f"{self.folder}/{ATTIC}/{self.pending_prefix}{stamp()}{suffix}"
        self.files.concat(list(lists), to)
        for path in lists:
            self.files.delete(path)
        return to

    def sources(self) -> list[DataFrame]:
        """The version in use, then each pending list."""
        return [self.products(), *(in_minutes(read_products(self.spark, p)) for p in self.pending())]

    def query(self, what: Search, limit_mode: str = "per_source") -> DataFrame:
        """Distinct paths found in the catalogue and the pending lists, ordered by start and path.

        limit_mode "per_source" limits each source before the union, "global" the whole.
        """
        if what is None:
            raise ValueError("no search")
        self._check_open()
        level = self.level
        limited = 0 < what.limit < UNLIMITED
        find = search if limited and limit_mode == "per_source" else unordered  # only a limit needs the order of a source
        found = None
        for products in self.sources():
            one = find(products if self.use_index or "cells" not in products.columns else products.drop("cells"), what, level).select("path", "start_min")
            found = one if found is None else found.unionByName(one)
        out = found.groupBy("path").agg(F.min("start_min").alias("start_min")).orderBy(F.asc_nulls_first("start_min"), "path")
        return (out.limit(what.limit) if limit_mode == "global" and limited else out).select("path")

    def dump(self) -> DataFrame:
        """All products as list lines, the catalogue's first; pending ones are not compared with them."""
        out = None
        for k, p in enumerate(self.sources()):
            one = p.select("path", "start_min", "end_min", "wkt", "ingest_seq").withColumn("source", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return dump_lines(out.orderBy("source", F.asc_nulls_first("start_min"), "ingest_seq"))


class SimpleCatalog(Catalog):
    """A catalogue without pending lists or an archive; a missing one is an error."""

    def __init__(self, spark: SparkSession, folder: str, **settings):
        super().__init__(spark, folder, **{"fail_if_missing": True, "archive": False} | settings)

    def pending(self) -> list[str]:
        return []

    def update(self, lists: Sequence[str] = ()) -> int:
        missing, self.fail_if_missing = self.fail_if_missing, False
        try:
            return super().update(lists)
        finally:
            self.fail_if_missing = missing


class TextCatalog:
    """A product list searched in place; it cannot be updated."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def products(self) -> DataFrame:
        return in_minutes(read_products(self.spark, self.path))

    def query(self, what: Search) -> DataFrame:
        found = unordered(self.products(), what)
        # What samples starts runs what is before it: only the found rows then, not the list's text again.
        return ordered(found if 0 < what.limit < UNLIMITED else found.repartition("ingest_seq"), what.limit).select("path")

    def size(self) -> int:
        return self.products().count()

    def update(self, lists: Sequence[str] = ()) -> int:
        raise RuntimeError("a text catalogue cannot be updated")
