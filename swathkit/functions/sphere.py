"""Geometry on the sphere: rings of unit vectors with geodesic edges.

A footprint is its outer ring, counter-clockwise, its inside the smaller side. Convex footprints have native column forms
(half-spaces, separating planes), which Catalyst compiles; general rings use Arrow-batched numpy. Points on an edge may
fall either way.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]
TOUCH = 1e-13  # sines of angles below this count as zero
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def read_wkt(wkt: str) -> Ring:
    """The outer ring of a WKT polygon as (lon, lat), without the closing point; anything else, a multipolygon too, is a ValueError."""
    plain = wkt[9:-2] if wkt and wkt.startswith("POLYGON ((") and wkt.endswith("))") else "("
    if "(" not in plain:
        n = [float(x) for x in plain[1:].replace(",", " ").split()]
        if len(n) >= 6 and len(n) == 2 * (plain.count(",") + 1):
            pairs = list(zip(n[::2], n[1::2], strict=True))
            return pairs[:-1] if pairs[0] == pairs[-1] and len(pairs) > 3 else pairs
    m = re.match(r"\s*POLYGON\s*(?:Z\s*)?\(\s*\(([^()]*)\)", wkt or "", re.IGNORECASE)
    pairs = [tuple(map(float, re.findall(NUMBER, p)[:2])) for p in m[1].split(",")] if m else []
    if len(pairs) < 3 or any(len(p) < 2 for p in pairs):
        raise ValueError(f"not a polygon: {wkt!r}")
    return pairs[:-1] if pairs[0] == pairs[-1] else pairs


def same_ring(a: Ring, b: Ring) -> bool:
    """Whether two rings have the same vertices in the same turn, wherever they start."""
    at = [k for k, p in enumerate(b) if p == a[0]] if len(a) == len(b) else []
    return any(a == b[k:] + b[:k] for k in at)


def same_polygon(a: str, b: str) -> bool:
    """Whether two WKT polygons are equal: the same ring, in either direction, as the inside is the smaller side."""
    x, y = read_wkt(a), read_wkt(b)
    return same_ring(x, y) or same_ring(x, y[::-1])


def write_wkt(ring: Ring) -> str:
    return "POLYGON ((" + ", ".join(f"{x:.12g} {y:.12g}" for x, y in [*ring, ring[0]]) + "))"


def xyz(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """np.cross of vectors of three, with fewer copies and the same bits."""
    (ax, ay, az), (bx, by, bz) = (a[..., 0], a[..., 1], a[..., 2]), (b[..., 0], b[..., 1], b[..., 2])
    return np.stack([ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx], axis=-1)


def areas(rings: np.ndarray) -> np.ndarray:
    """Steradians on the left of rings (n x vertices x 3), by triangles fanned from the first vertex (Eriksson's formula)."""
    a, b, c = rings[:, :1], rings[:, 1:-1], rings[:, 2:]
    dot = lambda u, v: (u * v).sum(axis=-1)
    return (2 * np.arctan2(dot(a, cross(b, c)), 1 + dot(a, b) + dot(a, c) + dot(b, c))).sum(axis=1) % (4 * np.pi)


def area(ring: np.ndarray) -> float:
    return float(areas(ring[None])[0])


def ring_of(wkt: str) -> np.ndarray:
    """Unit vectors of a polygon's outer ring, turned so that its inside, the smaller side, is on the left."""
    v = xyz(*np.array(read_wkt(wkt)).T)
    keep = np.abs(v - np.roll(v, 1, axis=0)).sum(axis=1) > 1e-15
    v = v[keep] if keep.sum() >= 3 else v
    return v[::-1].copy() if area(v) > 2 * np.pi else v


def _numbers(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Texts of single spaces and ", " alone, read without a step of Python a row: (places, n x vertices x 2) by the number of vertices; and the places of other texts, nulls not among them."""
    inner = pc.utf8_slice_codeunits(texts, 10, -2)
    parts = pc.split_pattern(pc.replace_substring(inner, ", ", " "), " ")
    size = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    commas = pc.fill_null(pc.count_substring(inner, ","), 0).to_numpy(zero_copy_only=False)
    shaped = pc.and_(pc.and_(pc.starts_with(texts, "POLYGON (("), pc.ends_with(texts, "))")), pc.invert(pc.match_substring(inner, "(")))
    known = pc.is_valid(texts).to_numpy(zero_copy_only=False)
    usual = pc.fill_null(shaped, False).to_numpy(zero_copy_only=False) & (size >= 6) & (size == 2 * (commas + 1))
    try:
        n = pc.cast(pc.list_flatten(parts.filter(pa.array(usual))), pa.float64()).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:  # some number is spelt in another way, or is none
        return [], np.flatnonzero(known)
    places, size = np.flatnonzero(usual), size[usual]
    first = np.cumsum(size) - size
    return [(places[size == k], n[first[size == k][:, None] + np.arange(k)].reshape(-1, k // 2, 2)) for k in np.unique(size).tolist()], np.flatnonzero(known & ~usual)


def plain_rings(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[int, str]]]:
    """Texts in the usual form read at once, as read_wkt() reads them: (places in texts, n x vertices x 2 of lon and lat); and the other texts with their places."""
    read, others = _numbers(texts)
    groups: dict[int, tuple[list[int], list[str], list[str]]] = {}
    rest = []
    for k, t in zip(others.tolist(), texts.take(pa.array(others)).to_pylist(), strict=True):
        n = t[10:-2].replace(",", " ").split() if t.startswith("POLYGON ((") and t.endswith("))") else ()
        if len(n) >= 6 and len(n) == 2 * (t.count(",") + 1) and t.rfind("(") == 9:
            at, own, numbers = groups.setdefault(len(n) // 2, ([], [], []))
            at.append(k)
            own.append(t)
            numbers += n
        else:
            rest.append((k, t))
    for size, (at, own, numbers) in groups.items():
        try:
            read.append((np.array(at), np.array(list(map(float, numbers))).reshape(len(at), size, 2)))
        except ValueError:
            rest += zip(at, own, strict=True)
    out = []
    for at, v in read:
        size = v.shape[1]
        closed = (v[:, 0] == v[:, -1]).all(axis=1) & (size > 3)
        for end, some in ((size - 1, closed), (size, ~closed)):
            if not some.any():
                continue
            ring, places = v[some, :end], at[some]
            twice = (ring == np.roll(ring, 1, axis=1)).all(axis=-1).any(axis=1)
            rest += [(k, texts[k].as_py()) for k in places[twice].tolist()]
            if not twice.all():
                out.append((places[~twice], ring[~twice]))
    return out, rest


def by_vertices(texts: Iterable[str | None] | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rings of many WKT texts at once: (places in texts, n x vertices x 3), groups with the same number of vertices; nulls are left out."""
    read, rest = plain_rings(texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string()))
    groups: dict[int, tuple[list[int], list[Ring]]] = {}
    for k, t in rest:
        ring = read_wkt(t)
        ring = [p for p, q in zip(ring, [ring[-1], *ring[:-1]], strict=True) if p != q] or ring
        at, rings = groups.setdefault(len(ring), ([], []))
        at.append(k)
        rings.append(ring)
    for at, v in [*read, *((np.array(at), np.array(rings)) for at, rings in groups.values())]:
        v = xyz(v[..., 0], v[..., 1])
        back = areas(v) > 2 * np.pi
        v[back] = v[back, ::-1]
        yield at, v


def winds(rings: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Whether each ring (n x vertices x 3) has its point (n x 3) inside: it winds once round it."""
    p = points[:, None, :]
    a = rings - p * (rings * p).sum(axis=-1, keepdims=True)
    b = np.roll(a, -1, axis=1)
    return np.arctan2((cross(a, b) * p).sum(axis=-1), (a * b).sum(axis=-1)).sum(axis=1) > np.pi


def contains(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Which points one ring has inside."""
    return winds(np.broadcast_to(ring, (len(points), *ring.shape)), points)


class Edges:
    """Many rings with as many vertices, prepared for pairs of a ring and a point."""

    def __init__(self, rings: np.ndarray):
        nxt = np.roll(rings, -1, axis=1)
        n = cross(rings, nxt)
        size = np.linalg.norm(n, axis=-1)
        m = n / np.maximum(size, 1e-15)[..., None]
        self.real, self.dots = size > 1e-15, (rings * nxt).sum(axis=-1)
        vectors = {"at": rings, "n": n, "m": m, "after": cross(m, rings), "before": cross(nxt, m)}
        self.parts = {k: [np.ascontiguousarray(v[..., x]) for x in range(3)] for k, v in vectors.items()}

    def along(self, part: str, ring: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Products of a part of each pair's ring with its point: pairs x vertices."""
        x, y, z = self.parts[part]
        return x[ring] * points[:, :1] + y[ring] * points[:, 1:2] + z[ring] * points[:, 2:]

    def inside(self, ring: np.ndarray, points: np.ndarray) -> np.ndarray:
        """winds() of pairs."""
        d = self.along("at", ring, points)
        return np.arctan2(self.along("n", ring, points), self.dots[ring] - d * np.roll(d, -1, axis=1)).sum(axis=1) > np.pi

    def away(self, ring: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Angles from points to the nearest edges of their rings."""
        x, y, z = self.parts["at"]
        chord = np.sqrt(((x[ring] - points[:, :1]) ** 2 + (y[ring] - points[:, 1:2]) ** 2 + (z[ring] - points[:, 2:]) ** 2).min(axis=1))
        beside = self.real[ring] & (self.along("after", ring, points) >= 0) & (self.along("before", ring, points) >= 0)
        across = np.where(beside, np.abs(self.along("m", ring, points)), 2).min(axis=1)
        ends = 2 * np.arcsin(np.clip(chord / 2, 0, 1))  # unlike an arccos, also exact for small angles
        return np.where(across < 2, np.minimum(ends, np.arcsin(np.clip(across, -1, 1))), ends)


def caps(rings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and angles of caps that hold the rings' insides; an angle of pi where the vertices do not fit a half sphere."""
    middle = rings.sum(axis=1)
    size = np.linalg.norm(middle, axis=1, keepdims=True)
    middle = np.where(size > 1e-9, middle / np.maximum(size, 1e-9), [0.0, 0.0, 1.0])
    reach = np.arccos(np.clip((rings * middle[:, None]).sum(axis=-1), -1, 1)).max(axis=1)
    return middle, np.where((reach < np.pi / 2) & (size[:, 0] > 1e-9), reach, np.pi)


def meet(rings: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Which rings' insides meet that of one ring: caps first, then vertices inside, then edges that cross."""
    out = np.zeros(len(rings), bool)
    (c, r), (cq, rq) = caps(rings), caps(query[None])
    near = np.flatnonzero(np.arccos(np.clip(c @ cq[0], -1, 1)) <= r + rq[0] + 1e-9)
    if len(near):
        a = rings[near]
        a2, q2 = np.roll(a, -1, axis=1), np.roll(query, -1, axis=0)
        na, nq = cross(a, a2), cross(query, q2)
        s1, s2 = na @ query.T, na @ q2.T  # the query's ends against a's edges
        s3, s4 = a @ nq.T, a2 @ nq.T
        found = winds(a, np.broadcast_to(query[0], (len(a), 3))) | contains(query, a[:, 0]) | ((s1 * s2 < 0) & (s3 * s4 < 0) & (s1 * s4 > 0)).any(axis=(1, 2))
        # rings with a vertex on the other's edge may share all of an inside without a crossing: points well inside decide
        touch = ~found & (np.minimum(np.abs(s1), np.abs(s3)).min(axis=(1, 2)) < TOUCH)
        for k in np.flatnonzero(touch):
            found[k] = any((contains(one, p) & contains(other, p)).any() for one, other in ((a[k], query), (query, a[k])) for p in [inner_points(one)])
        out[near] = found
    return out


def inner_points(ring: np.ndarray) -> np.ndarray:
    """The middles of a ring and of each three of its vertices in a row; some lie inside."""
    p = np.concatenate([ring.sum(axis=0)[None], ring + np.roll(ring, -1, axis=0) + np.roll(ring, -2, axis=0)])
    return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)


def intersects(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two rings' insides meet."""
    return bool(meet(a[None], b)[0])


def bounds(ring: np.ndarray) -> tuple[float, float, float, float]:
    """lat_lo, lat_hi, lng_lo, lng_hi in degrees; edges bulge toward the poles, a ring round a pole spans all longitudes, and lng_lo > lng_hi crosses the antimeridian."""
    return tuple(many_bounds(ring[None])[0].tolist())


def many_bounds(rings: np.ndarray) -> np.ndarray:
    """bounds() of many rings with as many vertices, one row each."""
    degrees = lambda z: np.degrees(np.arcsin(np.clip(z, -1, 1)))
    dot = lambda u, v: (u * v).sum(axis=-1)
    lat = degrees(rings[..., 2])
    lo, hi = lat.min(axis=1), lat.max(axis=1)
    nxt = np.roll(rings, -1, axis=1)
    m = cross(rings, nxt)
    size = np.linalg.norm(m, axis=-1)
    m = m / np.maximum(size, 1e-15)[..., None]
    top = np.stack([-m[..., 0] * m[..., 2], -m[..., 1] * m[..., 2], 1 - m[..., 2] ** 2], axis=-1)  # highest points of the great circles
    high = np.linalg.norm(top, axis=-1)
    top = top / np.maximum(high, 1e-12)[..., None]
    for sign in (1, -1):
        t = sign * top
        on = (size > 1e-15) & (high > 1e-12) & (dot(cross(rings, t), m) > 0) & (dot(cross(t, nxt), m) > 0)
        d = degrees(t[..., 2])
        lo, hi = (lo, np.maximum(hi, np.where(on, d, -90).max(axis=1))) if sign > 0 else (np.minimum(lo, np.where(on, d, 90).min(axis=1)), hi)
    north, south = (winds(rings, np.broadcast_to([0.0, 0.0, z], (len(rings), 3))) for z in (1.0, -1.0))
    lng = np.sort(np.degrees(np.arctan2(rings[..., 1], rings[..., 0])), axis=1)
    k = np.diff(np.concatenate([lng, lng[:, :1] + 360], axis=1), axis=1).argmax(axis=1)
    row, polar = np.arange(len(rings)), north | south
    west, east = lng[row, (k + 1) % lng.shape[1]], lng[row, k]
    return np.stack([np.where(south, -90.0, lo), np.where(north, 90.0, hi), np.where(polar, -180.0, west), np.where(polar, 180.0, east)], axis=1)


# Native column forms. A vector is a struct(x, y, z).


def vector(lon: Column, lat: Column) -> Column:
    lon, lat = F.radians(lon), F.radians(lat)
    return F.struct((F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))


def side(a: Column, b: Column, p: Column) -> Column:
    """(a x b) . p: above zero if p is left of the edge from a to b."""
    return (a["y"] * b["z"] - a["z"] * b["y"]) * p["x"] + (a["z"] * b["x"] - a["x"] * b["z"]) * p["y"] + (a["x"] * b["y"] - a["y"] * b["x"]) * p["z"]


def edges(ring: Column) -> Column:
    """array<struct(a, b)> of an array of vectors."""
    turned = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used, which a projection's columns are not."""
    return F.exists(F.array(value), use)


def convex_contains(ring: Column | list[Column], p: Column) -> Column:
    """Whether a convex counter-clockwise ring has a point inside; an array of vectors, or a list of them."""
    if isinstance(ring, list):
        n = len(ring)
        return let(F.array(*ring), lambda r: reduce(lambda x, y: x & y, [side(r[k], r[(k + 1) % n], p) >= 0 for k in range(n)]))
    return let(ring, lambda r: F.forall(edges(r), lambda e: side(e["a"], e["b"], p) >= 0))


def convex_intersects(a: Column, b: Column) -> Column:
    """Whether two convex counter-clockwise rings meet: no edge of either has all of the other outside."""
    apart = lambda one, other: F.exists(edges(one), lambda e: F.forall(other, lambda p: side(e["a"], e["b"], p) < 0))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda r: ~apart(r["a"], r["b"]) & ~apart(r["b"], r["a"]))


# Vectorised UDFs over WKT columns. Predicates count as nondeterministic, so that they stay where a plan puts them: pushed
# below a join or an aggregation they would run on many more rows.


def wkt_intersects(wkt: Column, region: str) -> Column:
    """Whether each WKT footprint meets the region."""
    query = ring_of(region)

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for at, rings in by_vertices(texts):
            out[at] = meet(rings, query)
        return pa.array(out)

    return run.asNondeterministic()(wkt)


def wkt_contains(wkt: Column, lon: Column, lat: Column) -> Column:
    """Whether each WKT footprint has its row's point inside."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series, lons: pd.Series, lats: pd.Series) -> pd.Series:
        points, out = xyz(lons.to_numpy(float), lats.to_numpy(float)), np.zeros(len(texts), bool)
        for at, rings in by_vertices(texts):
            out[at] = winds(rings, points[at])
        return pd.Series(out)

    return run.asNondeterministic()(wkt, lon, lat)


def wkt_area(wkt: Column) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        out = np.full(len(texts), np.nan)
        for at, rings in by_vertices(texts):
            out[at] = areas(rings)
        return pd.Series(out)

    return run(wkt)


def wkt_equal(a: Column, b: Column) -> Column:
    """Whether two WKT polygons are equal, as same_polygon() says."""

    @F.pandas_udf("boolean")
    def run(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([same_polygon(x, y) for x, y in zip(one, other, strict=True)], dtype=bool)

    return run(a, b)


def own_bounds(texts: pa.Array, at: np.ndarray, rings: np.ndarray) -> np.ndarray:
    """many_bounds() of the rings that by_vertices() read at these places."""
    out = many_bounds(rings)
    for k in np.flatnonzero((np.abs(rings - np.roll(rings, 1, axis=1)).sum(axis=-1) <= 1e-15).any(axis=1)):  # one place by two names
        out[k] = bounds(ring_of(texts[int(at[k])].as_py()))
    return out


def bounds_fields(values: np.ndarray) -> list[pa.Array]:
    """Arrow columns of rows of bounds; NaN is null."""
    return [pa.array(values[:, k], mask=np.isnan(values[:, k])) for k in range(4)]


BOUNDS = ("lat_lo", "lat_hi", "lng_lo", "lng_hi")


def wkt_bounds(wkt: Column) -> Column:
    """struct(lat_lo, lat_hi, lng_lo, lng_hi)."""

    @F.arrow_udf(f"struct<{','.join(f'{n}:double' for n in BOUNDS)}>")
    def run(texts: pa.Array) -> pa.Array:
        out = np.full((len(texts), 4), np.nan)
        for at, rings in by_vertices(texts):
            out[at] = own_bounds(texts, at, rings)
        return pa.StructArray.from_arrays(bounds_fields(out), list(BOUNDS))

    return run(wkt)
