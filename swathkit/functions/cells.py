"""Cells of a cube projected on the sphere, numbered along a Hilbert curve, in 64-bit and 30-bit form.

A 64-bit id has 3 bits of face, two bits a level, then a one and zeros. The 30-bit form keeps levels up to 13. A covering
is a sorted set of cells that together hold a footprint. Coverings here have one fixed level and may be larger than
needed, never smaller: they only prune. Fixed levels make overlap an equality, that is, an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from swathkit.functions.sphere import BOUNDS, Edges, areas, bounds_fields, by_vertices, caps, contains, own_bounds, ring_of, xyz

MAX_LEVEL, INT_LEVEL, DEFAULT_LEVEL = 30, 13, 4
POSITION_TO_IJ = ((0, 1, 3, 2), (0, 2, 3, 1), (3, 2, 0, 1), (3, 1, 0, 2))
IJ_TO_POSITION = tuple(tuple(row.index(ij) for ij in range(4)) for row in POSITION_TO_IJ)
TURN = (1, 0, 0, 3)


def face_uv(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Face and plane coordinates of unit vectors."""
    axis = np.abs(p).argmax(axis=1)
    face = axis + 3 * (p[np.arange(len(p)), axis] < 0)
    x, y, z = p.T
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.choose(face, [y / x, -x / y, -x / z, z / x, z / y, -y / z])
        v = np.choose(face, [z / x, z / y, -y / z, y / x, -x / y, -x / z])
    return face, u, v


def uv_xyz(face: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    one = np.ones_like(u)
    table = [(one, u, v), (-u, one, v), (-u, -v, one), (-one, -v, -u), (v, -one, -u), (v, u, -one)]
    out = np.stack([np.choose(face, [t[k] for t in table]) for k in range(3)], axis=-1)
    return out / np.linalg.norm(out, axis=-1, keepdims=True)


def uv_to_st(u: np.ndarray) -> np.ndarray:
    root = np.sqrt(1 + 3 * np.abs(u))
    return np.where(u >= 0, 0.5 * root, 1 - 0.5 * root)


def st_to_uv(s: np.ndarray) -> np.ndarray:
    return np.where(s >= 0.5, (4 * s * s - 1) / 3, (1 - 4 * (1 - s) ** 2) / 3)


def id_of_ij(face: np.ndarray, i: np.ndarray, j: np.ndarray, level: int) -> np.ndarray:
    """64-bit ids (as unsigned) of cells by their place in the face's grid of 2^level a side."""
    turn, pos = (face & 1).astype(np.int64), np.zeros(len(face), np.uint64)
    to_pos, swap = np.array(IJ_TO_POSITION), np.array(TURN)
    for k in range(level - 1, -1, -1):
        p = to_pos[turn, ((i >> k & 1) << 1) | (j >> k & 1)]
        pos = pos << np.uint64(2) | p.astype(np.uint64)
        turn ^= swap[p]
    shift = np.uint64(2 * (MAX_LEVEL - level))
    return (face.astype(np.uint64) << np.uint64(61)) | (pos << np.uint64(1) | np.uint64(1)) << shift


def cell_ids(points: np.ndarray, level: int = MAX_LEVEL) -> np.ndarray:
    """64-bit ids of the cells with these unit vectors."""
    face, u, v = face_uv(points)
    n = 1 << level
    i, j = (np.clip(np.floor(uv_to_st(x) * n), 0, n - 1).astype(np.int64) for x in (u, v))
    return id_of_ij(face, i, j, level)


def ids_of_place(lon: float, lat: float, levels: range = range(INT_LEVEL + 1)) -> list[tuple[int, int, int]]:
    """(level, 64-bit id as a signed number, 30-bit id) of the cells that hold a place."""
    p = xyz(np.array([lon]), np.array([lat]))
    return [(k, int(cell_ids(p, k).view(np.int64)[0]), int(int_of(cell_ids(p, k))[0])) for k in levels]


@lru_cache(8)
def grid(level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All cells of a level by ascending id: 30-bit ids, centres, and angles from a centre to its farthest corner."""
    n = 1 << level
    face, i, j = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(n), np.arange(n), indexing="ij"))
    at = lambda a, b: uv_xyz(face, st_to_uv((i + a) / n), st_to_uv((j + b) / n))
    centre = at(0.5, 0.5)
    corner = np.min([np.einsum("ij,ij->i", centre, at(a, b)) for a in (0.0, 1.0) for b in (0.0, 1.0)], axis=0)
    ids = int_of(id_of_ij(face, i, j, level))
    order = np.argsort(ids)
    return ids[order], centre[order], (np.arccos(np.clip(corner, -1, 1)) + 1e-9)[order]


def int_of(ids: np.ndarray) -> np.ndarray:
    """30-bit form of 64-bit ids of level 13 or less."""
    return (ids >> np.uint64(34)).astype(np.int64)


def distance(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Angles from points to the nearest edge of a ring."""
    nxt = np.roll(ring, -1, axis=0)
    n = np.cross(ring, nxt)
    size = np.linalg.norm(n, axis=1)
    chord = np.min([np.linalg.norm(points - q, axis=1) for q in ring], axis=0)
    ends = 2 * np.arcsin(np.clip(chord / 2, 0, 1))  # unlike an arccos, also exact for small angles
    for k in np.flatnonzero(size > 1e-15):
        m = n[k] / size[k]
        foot = np.cross(m, np.cross(points, m))
        inside = (np.cross(ring[k], foot) @ m >= 0) & (np.cross(foot, nxt[k]) @ m >= 0)
        ends = np.where(inside, np.minimum(ends, np.abs(np.arcsin(np.clip(points @ m, -1, 1)))), ends)
    return ends


def covering(ring: np.ndarray, level: int = DEFAULT_LEVEL) -> list[int]:
    """Sorted 30-bit ids of the level's cells whose surrounding cap meets the ring's inside."""
    ids, centre, radius = grid(level)
    middle = ring.sum(axis=0)
    norm = np.linalg.norm(middle)
    near = np.arange(len(ids))
    if norm > 1e-9:
        middle = middle / norm
        reach = np.arccos(np.clip(ring @ middle, -1, 1)).max()
        if reach < np.pi / 2:  # the cap round the ring's vertices holds its inside
            near = np.flatnonzero(np.arccos(np.clip(centre @ middle, -1, 1)) <= reach + radius)
    keep = contains(ring, centre[near]) | (distance(centre[near], ring) <= radius[near])
    return sorted(ids[near[keep]].tolist())


def covered_flat(rings: np.ndarray, level: int = DEFAULT_LEVEL) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids of covering() of many rings with as many vertices, one ring's after the other's, and their numbers.

    A cell whose cap meets the widest cap inside the ring is taken, one whose cap misses the cap round the ring is not; only
    those between are compared with edges.
    """
    ids, centre, radius = grid(level)
    edges, (middle, reach) = Edges(rings), caps(rings)
    every = np.arange(len(rings))
    room = np.where((reach < np.pi) & edges.inside(every, middle), edges.away(every, middle), -np.pi)
    dots = (middle @ centre.T).ravel()
    at = np.flatnonzero(dots.reshape(len(rings), -1) >= np.cos(np.minimum(reach + radius.max(), np.pi))[:, None] - 1e-12)
    ring, cell = np.divmod(at, len(ids))
    gap = np.arccos(np.clip(dots[at], -1, 1)) - radius[cell]
    keep = gap <= room[ring] - 1e-9
    open_ = np.flatnonzero(~keep & ((gap <= reach[ring] + 1e-9) | (reach[ring] == np.pi)))
    points = centre[cell[open_]]
    keep[open_] = near = edges.away(ring[open_], points) <= radius[cell[open_]]
    rest = np.flatnonzero(~near)
    keep[open_[rest]] = edges.inside(ring[open_[rest]], points[rest])
    return ids[cell[keep]].astype(np.int32), np.bincount(ring[keep], minlength=len(rings))


def covered(rings: np.ndarray, level: int = DEFAULT_LEVEL) -> list[np.ndarray]:
    """Sorted ids of covering() of many rings with as many vertices."""
    ids, count = covered_flat(rings, level)
    return np.split(ids, np.cumsum(count)[:-1])


def coverings(rings: np.ndarray, level: int = DEFAULT_LEVEL) -> list[list[int]]:
    """covering() of many rings with as many vertices."""
    return [x.tolist() for x in covered(rings, level)]


def cell_union(ring: np.ndarray, max_level: int = DEFAULT_LEVEL, min_level: int = 0, max_cells: int = 500) -> list[int]:
    """Sorted 64-bit ids, as signed numbers, of cells of mixed levels that together hold the ring's inside.

    From the faces down, cells wholly inside are kept, and those near an edge are replaced by their four parts that meet the
    ring, as long as no more than max_cells would be left and max_level is not reached. Four cells of one parent become it,
    unless it is above min_level. More than max_cells come of min_level alone.
    """
    cells = np.array([(f, 0, 0) for f in range(6)], np.int64)
    done: dict[int, list[np.ndarray]] = {}
    n_done = 0
    for level in range(max_level + 1):
        face, i, j = cells.T
        at = lambda a, b: uv_xyz(face, st_to_uv((i + a) / (1 << level)), st_to_uv((j + b) / (1 << level)))  # noqa: B023, E731
        centre = at(0.5, 0.5)
        radius = np.max([2 * np.arcsin(np.linalg.norm(at(a, b) - centre, axis=-1) / 2) for a in (0.0, 1.0) for b in (0.0, 1.0)], axis=0) + 1e-9
        inside, away = contains(ring, centre), distance(centre, ring)
        meets, whole = inside | (away <= radius), inside & (away > radius)
        cells, whole = cells[meets], whole[meets]
        parts = cells[~whole]
        last = level == max_level or (level >= min_level and n_done + whole.sum() + 4 * len(parts) > max_cells)
        if last or level >= min_level:
            keep = cells if last else cells[whole]
            done.setdefault(level, []).append(keep)
            n_done += len(keep)
            if last:
                break
            cells = parts
        cells = np.concatenate([cells * [1, 2, 2] + [0, a, b] for a in (0, 1) for b in (0, 1)])
    out: list[int] = []
    merged = np.empty((0, 3), np.int64)
    for level in range(max(done, default=0), -1, -1):
        own = np.unique(np.concatenate([merged, *done.get(level, [])]), axis=0)
        merged = merged[:0]
        if level > min_level and len(own):
            up, back, count = np.unique(own // [1, 2, 2], axis=0, return_inverse=True, return_counts=True)
            full = count[back.ravel()] == 4
            merged, own = up[count == 4], own[~full]
        if len(own):
            out += id_of_ij(own[:, 0], own[:, 1], own[:, 2], level).view(np.int64).tolist()
    return sorted(out)


def cell_unions(rings: np.ndarray, max_level: int = DEFAULT_LEVEL, min_level: int = 0, max_cells: int = 500) -> list[np.ndarray]:
    """cell_union() of many rings with as many vertices, all of them refined level by level at once."""
    n, edges = len(rings), Edges(rings)
    ring = np.repeat(np.arange(n), 6)
    cells = np.zeros((6 * n, 3), np.int64)
    cells[:, 0] = np.tile(np.arange(6), n)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    n_done = np.zeros(n, np.int64)
    for level in range(max_level + 1):
        face, i, j = cells.T
        at = lambda a, b: uv_xyz(face, st_to_uv((i + a) / (1 << level)), st_to_uv((j + b) / (1 << level)))  # noqa: B023, E731
        centre = at(0.5, 0.5)
        radius = np.max([2 * np.arcsin(np.linalg.norm(at(a, b) - centre, axis=-1) / 2) for a in (0.0, 1.0) for b in (0.0, 1.0)], axis=0) + 1e-9
        inside, near = edges.inside(ring, centre), edges.away(ring, centre) <= radius
        meets, whole = inside | near, inside & ~near
        ring, cells, whole = ring[meets], cells[meets], whole[meets]
        n_whole, n_parts = np.bincount(ring[whole], minlength=n), np.bincount(ring[~whole], minlength=n)
        last = np.full(n, level == max_level) | ((level >= min_level) & (n_done + n_whole + 4 * n_parts > max_cells))
        take = last[ring] | (whole & (level >= min_level))
        done.append((ring[take], id_of_ij(*cells[take].T, level)))
        n_done += np.bincount(ring[take], minlength=n)
        ring, cells = np.repeat(ring[~take], 4), np.repeat(cells[~take], 4, axis=0) * [1, 2, 2] + np.tile([[0, a, b] for a in (0, 1) for b in (0, 1)], ((~take).sum(), 1))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    ring, ids = np.empty(0, np.int64), np.empty(0, np.uint64)
    for level in range(len(done) - 1, -1, -1):
        ring, ids = (np.concatenate(x) for x in zip((ring, ids), done[level], strict=True))
        full = np.zeros(len(ring), bool)
        if level > min_level:
            bit = np.uint64(1) << np.uint64(2 * (MAX_LEVEL - level + 1))
            up = (ids & ~(bit | (bit - np.uint64(1)))) | bit
            order = np.lexsort((up, ring))
            ring, ids, up = ring[order], ids[order], up[order]
            first = np.flatnonzero(np.append(True, (ring[1:] != ring[:-1]) | (up[1:] != up[:-1]))) if len(ring) else np.empty(0, np.int64)
            count = np.diff(np.append(first, len(ring)))
            full = np.repeat(count == 4, count)
            out.append((ring[~full], ids[~full]))
            ring, ids = ring[first[count == 4]], up[first[count == 4]]
        else:
            out.append((ring, ids))
            ring, ids = ring[:0], ids[:0]
    ring, ids = (np.concatenate(x) for x in zip(*out, strict=True))
    ids = ids.view(np.int64)
    order = np.lexsort((ids, ring))
    return np.split(ids[order], np.searchsorted(ring[order], np.arange(1, n)))


def wkt_cell_union(wkt: Column, max_level: int = DEFAULT_LEVEL, min_level: int = 0, max_cells: int = 500) -> Column:
    """array<bigint> of cell_union() of each WKT footprint."""

    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(texts)
        for at, rings in by_vertices(texts):
            for k in range(0, len(at), 256):
                for row, cells in zip(at[k : k + 256].tolist(), cell_unions(rings[k : k + 256], max_level, min_level, max_cells), strict=True):
                    out[row] = cells
        return pd.Series(out)

    return run.asNondeterministic()(wkt)


def leaf_cell(lon: Column, lat: Column) -> Column:
    """64-bit id, as a signed number, of each point's cell of the last level."""

    @F.pandas_udf("bigint")
    def run(lons: pd.Series, lats: pd.Series) -> pd.Series:
        return pd.Series(cell_ids(xyz(lons.to_numpy(float), lats.to_numpy(float))).view(np.int64))

    return run.asNondeterministic()(lon, lat)


def interior(ring: np.ndarray, level: int = DEFAULT_LEVEL) -> list[int]:
    """Sorted ids of cells that lie wholly inside."""
    ids, centre, radius = grid(level)
    return sorted(ids[contains(ring, centre) & (distance(centre, ring) > radius)].tolist())


def union_size(parts: dict[int, np.ndarray]) -> int:
    """Number of cells (face, i, j by level) after each four of one parent are replaced by it."""
    n, merged = 0, np.empty((0, 3), np.int64)
    for level in range(max(parts, default=0), -1, -1):
        cells = np.concatenate([merged, parts.get(level, merged[:0])])
        if not level:
            return n + len(cells)
        up, count = np.unique(cells // [1, 2, 2], axis=0, return_counts=True)
        n += int(count[count < 4].sum())
        merged = up[count == 4]
    return n


def refined(ring: np.ndarray, last: int) -> Iterator[tuple[int, float, int, int, int, int]]:
    """Level, exact area, union_size and number of cells of covering(), and both of interior(), for levels 0 to last.

    Only cells near the ring's edges are refined. A cell with its centre inside and no edge within twice its radius is kept
    whole: all cells below it are in covering() and interior(). One outside, as far from the edges, has none below it.
    """
    cells = np.array([(f, 0, 0) for f in range(6)], np.int64)
    whole: dict[int, np.ndarray] = {}
    whole_area, whole_n = 0.0, 0
    for level in range(last + 1):
        cover, inner, settled, near, area, new_area = [], [], [], [], 0.0, 0.0
        for part in np.array_split(cells, max(1, len(cells) * len(ring) // 500_000)):
            face, i, j = part.T
            at = lambda a, b: uv_xyz(face, st_to_uv((i + a) / (1 << level)), st_to_uv((j + b) / (1 << level)))  # noqa: B023, E731
            centre, corners = at(0.5, 0.5), np.stack([at(0.0, 0.0), at(1.0, 0.0), at(1.0, 1.0), at(0.0, 1.0)], axis=1)
            radius = 2 * np.arcsin(np.linalg.norm(corners - centre[:, None], axis=-1).max(axis=1) / 2) + 1e-9
            inside, away = contains(ring, centre), distance(centre, ring)
            covers, edge = inside | (away <= radius), away <= 2 * radius
            size = np.where(covers, areas(corners), 0.0)
            area += float(size.sum())
            new_area += float(size[inside & ~edge].sum())
            cover.append(part[covers])
            inner.append(part[inside & (away > radius)])
            settled.append(part[inside & ~edge])
            near.append(part[edge])
        new = np.concatenate(settled)
        covered, within = np.concatenate(cover), np.concatenate(inner)
        yield level, whole_area + area, union_size({**whole, level: covered}), whole_n + len(covered), union_size({**whole, level: within}), whole_n + len(within)
        whole[level], whole_n, whole_area = new, 4 * (whole_n + len(new)), whole_area + new_area
        edge_cells = np.concatenate(near)
        cells = np.concatenate([edge_cells * [1, 2, 2] + [0, a, b] for a in (0, 1) for b in (0, 1)])


def cell_area(level: int = DEFAULT_LEVEL) -> float:
    return 4 * np.pi / (6 * 4**level)


# Columns. The vectorised ones count as nondeterministic, as in sphere: they stay where a plan puts them.


PAIRS = 400_000  # of a ring and a cell, compared at once


def _lists(n: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Array:
    """Lists of n rows from parts of (places of rows, flat values, numbers of values); rows of no part are null."""
    count, known = np.zeros(n, np.int64), np.zeros(n, bool)
    for at, _, own in parts:
        count[at], known[at] = own, True
    offsets = np.append(0, np.cumsum(count))
    values = np.empty(offsets[-1], np.int32)
    for at, flat, own in parts:
        values[np.repeat(offsets[at] - (np.cumsum(own) - own), own) + np.arange(len(flat))] = flat
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=pa.array(~known))


def _cells(at: np.ndarray, rings: np.ndarray, level: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    n = max(1, PAIRS // (6 * 4**level))
    return [(at[k : k + n], *covered_flat(rings[k : k + n], level)) for k in range(0, len(at), n)]


def wkt_covering(wkt: Column, level: int = DEFAULT_LEVEL) -> Column:
    """array<int> of the cells that cover each WKT footprint."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return _lists(len(texts), [part for at, rings in by_vertices(texts) for part in _cells(at, rings, level)])

    return run.asNondeterministic()(wkt)


def wkt_geometry(wkt: Column, level: int = DEFAULT_LEVEL) -> Column:
    """struct(cells, lat_lo, lat_hi, lng_lo, lng_hi): wkt_covering() and wkt_bounds() of a text that is read once."""

    @F.arrow_udf(f"struct<cells:array<int>,{','.join(f'{n}:double' for n in BOUNDS)}>")
    def run(texts: pa.Array) -> pa.Array:
        parts, box = [], np.full((len(texts), 4), np.nan)
        for at, rings in by_vertices(texts):
            parts += _cells(at, rings, level)
            box[at] = own_bounds(texts, at, rings)
        return pa.StructArray.from_arrays([_lists(len(texts), parts), *bounds_fields(box)], ["cells", *BOUNDS])

    return run.asNondeterministic()(wkt)


def point_cell(lon: Column, lat: Column, level: int = DEFAULT_LEVEL) -> Column:
    """30-bit id of each point's cell."""

    @F.arrow_udf("int")
    def run(lons: pa.Array, lats: pa.Array) -> pa.Array:
        return pa.array(int_of(cell_ids(xyz(*(x.to_numpy(zero_copy_only=False).astype(float) for x in (lons, lats))), level)).astype(np.int32))

    return run.asNondeterministic()(lon, lat)


def as_int(cell: Column) -> Column:
    """30-bit form of a 64-bit id (signed long); levels above 13 become their ancestor of level 13."""
    one = F.shiftleft(F.lit(1).cast("long"), 34)
    fine = lowest_on_bit(cell) < one
    deep = F.when((cell < 0) | (cell > 0), cell.bitwiseAND(F.lit(~((1 << 35) - 1))).bitwiseOR(one))
    return F.shiftrightunsigned(F.when(fine & (lowest_on_bit(cell) > 0), deep).otherwise(cell), 34).cast("int")


def as_int_at_level(cell: Column, level: int) -> Column:
    """Face and position of the id's ancestor at a level, without the closing one."""
    return F.shiftrightunsigned(cell, 61 - 2 * level).cast("int")


def lowest_on_bit(x: Column) -> Column:
    return x.bitwiseAND(-x)


def range_min(x: Column) -> Column:
    return x - (lowest_on_bit(x) - 1)


def range_max(x: Column) -> Column:
    return x + (lowest_on_bit(x) - 1)


def covering_contains(cells: Column, cell: Column) -> Column:
    """Whether a covering of any levels has a cell or one of its ancestors. A cell's range does not leave its face, nor so the sign."""
    return F.exists(cells, lambda c: (range_min(c) <= cell) & (cell <= range_max(c)))


def coverings_meet(a: Column, b: Column) -> Column:
    """Whether coverings of any levels have cells of which one holds the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (range_min(x) <= range_max(y)) & (range_min(y) <= range_max(x))))
