"""Rings, coverings and cell ids."""

import numpy as np
import pytest

from swathkit.functions import cells as C
from swathkit.functions import sphere as S


def box(x, y, a, b):
    return S.ring_of(f"POLYGON (({x} {y}, {x + a} {y}, {x + a} {y + b}, {x} {y + b}, {x} {y}))")


def test_wkt():
    ring = S.read_wkt("polygon((-71.00 41, -52 41,-52 5.2e1, -71 52, -71 41))")
    assert ring == [(-71, 41), (-52, 41), (-52, 52), (-71, 52)] == S.read_wkt(S.write_wkt(ring))
    for bad in ("POINT (1 2)", "", "POLYGON ((1 2, 3 4))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", None):
        with pytest.raises(ValueError):
            S.read_wkt(bad)


def test_contains_poles_and_antimeridian():
    cap = S.ring_of("POLYGON ((0 70, 90 70, 180 70, -90 70, 0 70))")
    assert S.contains(cap, S.xyz([33.0, 0.0], [89.0, 60.0])).tolist() == [True, False]
    across = S.ring_of("POLYGON ((170 -10, -170 -10, -170 10, 170 10, 170 -10))")
    assert S.contains(across, S.xyz([180.0, -175.0, 0.0, 160.0], [0.0, 5.0, 0.0, 0.0])).tolist() == [True, True, False, False]
    clockwise = S.ring_of("POLYGON ((0 0, 0 10, 10 10, 10 0, 0 0))")
    assert S.contains(clockwise, S.xyz([5.0, 15.0], [5.0, 5.0])).tolist() == [True, False]
    assert abs(S.area(S.ring_of("POLYGON ((0 0, 90 0, 0 90, 0 0))")) - np.pi / 2) < 1e-12


def test_intersects():
    a = box(0, 0, 10, 10)
    assert S.intersects(a, box(5, 5, 2, 2)) and S.intersects(box(5, 5, 2, 2), a) and S.intersects(a, box(-5, 4, 20, 2)) and not S.intersects(a, box(11, 0, 5, 5))
    rng = np.random.default_rng(1)
    for _ in range(200):
        x, y = rng.uniform(-60, 60, 2)
        other = box(x, y, *rng.uniform(2, 15, 2))
        edges = lambda r: list(zip(r, np.roll(r, -1, axis=0), strict=True))
        apart = any(all(np.cross(u, v) @ p < 0 for p in t) for r, t in ((a, other), (other, a)) for u, v in edges(r))
        assert S.intersects(a, other) != apart


def test_bounds_hold_the_bulge():
    lo, hi, west, east = S.bounds(box(-40, 50, 80, 10))
    assert hi > 60.5 and abs(lo - 50) < 1e-9 and abs(west + 40) < 1e-9 and abs(east - 40) < 1e-9
    assert S.bounds(S.ring_of("POLYGON ((170 -10, -170 -10, -170 10, 170 10, 170 -10))"))[2:] == pytest.approx((170, -170))


def test_cells_nest_and_follow_the_curve():
    p = S.xyz(np.array([10.0, -120.3, 77.7, 179.9]), np.array([42.0, -33.3, 89.0, 0.1]))
    leaf, four = C.cell_ids(p), C.cell_ids(p, 4)
    low = four & (~four + np.uint64(1))
    assert ((four - low < leaf) & (leaf < four + low)).all()
    for level in (0, 1, 3):
        ids, centre, _ = C.grid(level)
        assert len(set(ids.tolist())) == 6 * 4**level and (C.int_of(C.cell_ids(centre, level)) == ids).all()
        order = np.argsort(C.cell_ids(centre, level))
        if level:
            steps = np.arccos(np.clip((centre[order][1:] * centre[order][:-1]).sum(axis=1), -1, 1))
            assert steps.max() < 2.2 * np.pi / 2 / 2**level


def test_covering_is_a_superset_and_prunes_nothing_needed():
    rng = np.random.default_rng(2)
    rings = [box(x, y, a, b) for x, y, a, b in zip(rng.uniform(-170, 160, 40), rng.uniform(-80, 60, 40), rng.uniform(1, 20, 40), rng.uniform(1, 20, 40), strict=True)]
    many = C.coverings(np.array(rings))
    for ring, cover in zip(rings, many, strict=True):
        assert set(cover) >= set(C.covering(ring)) - set() and set(C.interior(ring)) <= set(cover)
        points = S.xyz(rng.uniform(-180, 180, 4000), rng.uniform(-85, 85, 4000))
        inside = points[S.contains(ring, points)]
        assert set(C.int_of(C.cell_ids(inside, 4)).tolist()) <= set(cover)


def test_columns_agree_with_numpy(spark):
    from pyspark.sql import functions as F

    ids = C.cell_ids(S.xyz(np.array([10.0, -100.0]), np.array([42.0, 7.0])), 13)
    df = spark.createDataFrame([(int(x.view(np.int64)),) for x in ids], "c long")
    got = df.select(C.as_int(F.col("c")), C.as_int_at_level(F.col("c"), 4), C.range_min(F.col("c")), C.range_max(F.col("c"))).collect()
    for x, r in zip(ids.tolist(), got, strict=True):
        low = x & -x
        signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
        assert tuple(r) == (x >> 34, x >> 53, signed(x) - (low - 1), signed(x) + (low - 1))
    leaf = C.cell_ids(S.xyz(np.array([10.0]), np.array([42.0])))
    one = spark.createDataFrame([(int(leaf[0].view(np.int64)),)], "c long").select(C.as_int(F.col("c"))).first()[0]
    assert one == int(ids[0]) >> 34


def test_polygon_equality():
    a = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"
    assert S.same_polygon(a, "POLYGON((10 10,0 10,0 0,10 0,10 10))") and S.same_polygon(a, "POLYGON ((0 0, 0 10, 10 10, 10 0, 0 0))")
    assert not S.same_polygon(a, "POLYGON ((0 0, 10 0, 10 10, 0 11, 0 0))") and not S.same_polygon(a, "POLYGON ((0 0, 10 0, 10 10, 0 0))")


def test_cell_unions_hold_the_ring():
    """Points inside a ring are in its cells of mixed levels; bounds on levels and number hold; more cells fit closer."""
    rng = np.random.default_rng(4)
    for ring in (box(0, 0, 10, 10), box(-70, 41, 19, 11), S.ring_of("POLYGON ((170 60, -150 60, -140 85, 160 85, 170 60))"), S.ring_of("POLYGON ((0 70, 90 70, 180 70, -90 70, 0 70))")):
        points = S.xyz(rng.uniform(-180, 180, 40_000), np.degrees(np.arcsin(rng.uniform(-1, 1, 40_000))))
        leaves = C.cell_ids(points[S.contains(ring, points)])
        sizes = []
        for most in (6, 20, 500):
            ids = np.array(C.cell_union(ring, 8, 0, most), np.int64).view(np.uint64)
            low = ids & (~ids + np.uint64(1))
            held = ((leaves[:, None] >= ids - (low - np.uint64(1))) & (leaves[:, None] <= ids + (low - np.uint64(1)))).any(axis=1)
            assert held.all() and len(leaves) and 0 < len(ids) <= most
            levels = 30 - np.log2(low.astype(float)).astype(int) // 2
            assert levels.max() <= 8
            sizes.append(float((4 * np.pi / (6 * 4.0 ** levels)).sum()))
        assert sizes[0] >= sizes[1] >= sizes[2] >= S.area(ring) * 0.8
        assert all(30 - (int(x) & -int(x)).bit_length() // 2 >= 3 for x in C.cell_union(ring, 5, 3))
