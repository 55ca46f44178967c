"""Searches of a product catalogue, as one Spark plan each.

Products: path, start_min, end_min (NULL: none), wkt, ingest_seq, and, if stored, cells and bounds. A search is a frozen
description that compiles to: time filter (native, pushed to the scan) -> bounds and cell overlap (native) -> exact geometry
(Arrow) -> start order -> limit. Results carry path, start_min and ingest_seq.

Time rule "reference" (the default): products are taken in start order from the first with the query's start minute, or
else from the last before it; so of products that started earlier only that one can match. "overlap" takes all whose
interval meets the range. A product without times matches any range. Points given with a search, as a list or as a table,
replace its region.
"""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathkit.functions import cells as C
from swathkit.functions.sphere import BOUNDS, bounds, read_wkt, ring_of, wkt_contains, wkt_intersects, xyz
from swathkit.functions.times import DAY_MS, MINUTE_MS, literal_ms

UNLIMITED = 2**31 - 1


@dataclass(frozen=True)
class DateRange:
    """Milliseconds; start inclusive, end exclusive; None is open."""

    start: int | None = None
    end: int | None = None

    @property
    def start_min(self) -> int | None:
        return None if self.start is None else self.start // MINUTE_MS

    @property
    def end_min(self) -> int | None:
        return None if self.end is None else -(-self.end // MINUTE_MS)


@dataclass(frozen=True)
class Search:
    """What to look for; build with the with_* methods, each of which returns a new search."""

    name: str = ""
    region: str | None = None
    ranges: tuple[DateRange, ...] = ()
    start_only: bool = False
    points: tuple[tuple[int | None, float, float], ...] = ()
    delta_ms: int | None = None
    limit: int = UNLIMITED
    time_rule: str = field(default="reference", compare=False)
    point_table: DataFrame | None = field(default=None, compare=False, repr=False)

    def with_region(self, wkt: str) -> Search:
        """Search footprints that meet a WKT polygon; anything else is a ValueError."""
        read_wkt(wkt)
        return replace(self, region=wkt)

    def with_dates(self, start: str | dt.datetime | None = None, end: str | dt.datetime | None = None) -> Search:
        """Add a range of days; the end day is included, so 24 hours are added to the end whatever its time."""
        last = literal_ms(end)
        return replace(self, ranges=(*self.ranges, DateRange(literal_ms(start), None if last is None else last + DAY_MS)))

    def with_start_only(self, value: bool = True) -> Search:
        """Compare a product's start, not its end, with a range's start."""
        return replace(self, start_only=value)

    def with_points(self, points) -> Search:
        """Add points (time in ms or None, lon, lat)."""
        return replace(self, points=(*self.points, *((None if t is None else int(t), float(x), float(y)) for t, x, y in points)))

    def with_point_table(self, points: DataFrame) -> Search:
        """Search with a table of points (rec_id, time_ms, lon, lat), as records() reads them; it is never collected."""
        return replace(self, point_table=points)

    def with_delta(self, ms: int) -> Search:
        """How far from a point's time a product may be; -1 for no limit."""
        return replace(self, delta_ms=None if ms == -1 else ms)

    def with_limit(self, n: int) -> Search:
        """At most n results; 0 or less is no limit."""
        return replace(self, limit=n)

    def with_time_rule(self, rule: str) -> Search:
        if rule not in ("reference", "overlap"):
            raise ValueError(f"no such time rule: {rule}")
        return replace(self, time_rule=rule)

    @property
    def all_ranges(self) -> tuple[DateRange, ...]:
        return self.ranges or (DateRange(),)

    def __str__(self) -> str:
        show = lambda ms, back: "null" if ms is None else dt.datetime.fromtimestamp((ms - back) / 1000, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
        ranges = ", ".join(f"[{show(r.start, 0)}, {show(r.end, DAY_MS)}]" for r in self.all_ranges)
        return f"Search(name={self.name!r}, region={self.region}, ranges=[{ranges}], start_only={self.start_only}, points={len(self.points)}{' and a table' if self.point_table is not None else ''}, delta_ms={self.delta_ms}, limit={self.limit})"


def place() -> Column:
    """A product's place in start order, comparable as a struct."""
    return F.struct("start_min", "ingest_seq")


def starts_around(products: DataFrame, ranges: Sequence[DateRange]) -> Column:
    """For each range with a start, whether a product starts in its first minute, and the last product before it: fields e0, b0, e1, ... of one row, made in one pass."""
    own = F.col("start_min")
    parts = []
    for k, r in enumerate(ranges):
        if r.start_min is not None:
            parts += [F.coalesce(F.max(own == r.start_min), F.lit(False)).alias(f"e{k}"), F.max(F.when(own < r.start_min, place())).alias(f"b{k}")]
    return products.agg(F.struct(*parts).alias("x")).scalar()


def in_range(products: DataFrame, r: DateRange, start_only: bool, rule: str = "reference", around: Column | None = None, k: int = 0) -> Column:
    """Whether a product matches a range; around: starts_around() of several ranges, of which this is the k-th."""
    q, e = r.start_min, r.end_min
    ends = F.lit(True) if e is None else F.col("start_min") < e
    if q is None:
        return F.col("start_min").isNull() | ends
    own = F.col("start_min") if start_only else F.col("end_min")
    late = own >= q
    if rule == "overlap" or start_only:
        return F.col("start_min").isNull() | (ends & late)
    around = starts_around(products, [DateRange()] * k + [r]) if around is None else around
    before = around[f"b{k}"]
    last = ~around[f"e{k}"] & (F.col("start_min") == before["start_min"]) & (F.col("ingest_seq") == before["ingest_seq"])
    return F.col("start_min").isNull() | (ends & late & ((F.col("start_min") >= q) | F.coalesce(last, F.lit(False))))


def time_filter(products: DataFrame, search: Search) -> DataFrame:
    """Products in any of the search's ranges."""
    ranges = search.all_ranges
    needs = search.time_rule == "reference" and not search.start_only and any(r.start_min is not None for r in ranges)
    around = starts_around(products, ranges) if needs else None
    any_range = None
    for k, r in enumerate(ranges):
        one = in_range(products, r, search.start_only, search.time_rule, around, k)
        any_range = one if any_range is None else any_range | one
    return products.filter(any_range)


def in_bounds(box: tuple[float, float, float, float], slack: float = 1e-9) -> Column:
    """Whether a footprint's stored bounds meet a box (lat_lo, lat_hi, lng_lo, lng_hi); lng_lo above lng_hi crosses the antimeridian. Those without bounds pass."""
    south, north, west, east = box
    east += 360 * (east < west)
    lo, hi = F.col("lng_lo"), F.col("lng_hi") + F.when(F.col("lng_hi") < F.col("lng_lo"), 360.0).otherwise(0.0)
    across = F.lit(False)
    for turn in (-360.0, 0.0, 360.0):
        across = across | ((lo <= east + turn + slack) & (hi >= west + turn - slack))
    return F.col("lat_lo").isNull() | F.isnan("lat_lo") | ((F.col("lat_lo") <= north + slack) & (F.col("lat_hi") >= south - slack) & across)


def on_cells(cells: list[int]) -> Column:
    """Whether a footprint's stored cells have any of these."""
    return F.arrays_overlap("cells", F.array(*[F.lit(c) for c in cells]).cast("array<int>"))


def pruned(products: DataFrame, box: tuple[float, float, float, float], cells: list[int]) -> DataFrame:
    """Products that may have to do with a place: by stored bounds, then by stored cells, if there are any."""
    if set(BOUNDS) <= set(products.columns):
        products = products.filter(in_bounds(box))
    if "cells" in products.columns:
        products = products.filter(on_cells(cells))
    return products


def region_filter(products: DataFrame, region: str | None, level: int = C.DEFAULT_LEVEL) -> DataFrame:
    """Products whose footprint meets the region."""
    if region is None:
        return products
    ring = ring_of(region)
    return pruned(products, bounds(ring), C.covering(ring, level)).filter(wkt_intersects(F.col("wkt"), region))


def ordered(products: DataFrame, limit: int = UNLIMITED) -> DataFrame:
    """In start order, products without times first; a limit of 0 or less is none."""
    out = products.orderBy(F.asc_nulls_first("start_min"), "ingest_seq")
    return out.limit(limit) if 0 < limit < UNLIMITED else out


def search(products: DataFrame, what: Search, level: int = C.DEFAULT_LEVEL) -> DataFrame:
    """The products found: path, start_min, ingest_seq, in order."""
    return ordered(unordered(products, what, level), what.limit)


def unordered(products: DataFrame, what: Search, level: int = C.DEFAULT_LEVEL) -> DataFrame:
    """The products found, without the search's limit and in any order."""
    if what.points or what.point_table is not None:
        if what.region:
            warnings.warn("the region is ignored, as points are given", stacklevel=2)
        from swathkit.plans.matchup import matchup

        spark = products.sparkSession
        points = spark.createDataFrame([(-k - 1, *p) for k, p in enumerate(what.points)], "rec_id long, time_ms long, lon double, lat double")
        if what.point_table is not None:
            points = points.unionByName(what.point_table.select("rec_id", "time_ms", "lon", "lat"))
        found = matchup(products, points, what, level)
    else:
        found = region_filter(time_filter(products, what), what.region, level)
    return found.select("path", "start_min", "ingest_seq")


def with_positions(products: DataFrame) -> DataFrame:
    """Adds pid, the 0-based position in start order (products without times first).

    Rows are numbered within the minute they start in (those without times within a stretch of places), minutes within days get
    the sum of those before, and days that of the days before: no partition holds all rows, nor all of a day, and the
    table of sums has a row a day.
    """
    timed = F.when(F.col("start_min").isNull(), F.lit(0)).otherwise(F.lit(1))
    slot = F.when(F.col("start_min").isNull(), F.shiftright(F.col("ingest_seq"), 20)).otherwise(F.col("start_min").cast("long"))
    keyed = products.withColumns({"_timed": timed, "_slot": slot})
    slots = keyed.groupBy("_timed", "_slot").agg(F.count("*").alias("_n")).withColumn("_day", F.floor(F.col("_slot") / 1440))
    ahead = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = slots.groupBy("_timed", "_day").agg(F.sum("_n").alias("_n"))
    days = days.select("_timed", "_day", ahead(Window.orderBy("_timed", "_day")).alias("_days_before"))
    within = slots.withColumn("_before", ahead(Window.partitionBy("_timed", "_day").orderBy("_slot")))
    offsets = within.join(days, ["_timed", "_day"]).select("_timed", "_slot", (F.col("_before") + F.col("_days_before")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_timed", "_slot").orderBy("ingest_seq"))
    return keyed.withColumn("_k", number).join(offsets, ["_timed", "_slot"]).withColumn("pid", F.col("_before") + F.col("_k") - 1).drop("_timed", "_slot", "_k", "_before")


def footprint_contains(products: DataFrame, lon: float, lat: float, level: int = C.DEFAULT_LEVEL) -> DataFrame:
    """Products whose footprint has a point inside."""
    cell = C.int_of(C.cell_ids(xyz(np.array([lon]), np.array([lat])), level)).tolist()
    east = lon - 360 if lon > 180 else lon
    return pruned(products, (lat, lat, east, east), cell).filter(wkt_contains(F.col("wkt"), F.lit(lon), F.lit(lat)))
