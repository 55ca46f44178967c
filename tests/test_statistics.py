"""Levels of footprints against brute force, and the statistics over them."""

from collections import defaultdict

import numpy as np
import pytest

from swathkit.functions import cells as C
from swathkit.functions import sphere as S
from swathkit.operators import statistics as ST


def wkt(x, y, a, b):
    return f"POLYGON (({x} {y}, {x + a} {y}, {x + a} {y + b}, {x} {y + b}, {x} {y}))"


# One cell at levels 0 and 1 (well inside a cell of level 1), small ones, a swath, and one round a pole.
WKT = {"one": wkt(22, 20, 1, 1), "box": wkt(10, 40, 10, 10), "small": wkt(-70.3, -33.1, 0.3, 0.2), "tiny": wkt(10, 40, 0.02, 0.02), "swath": wkt(-120, -50, 2, 60), "pole": "POLYGON ((0 70, 90 70, 180 70, -90 70, 0 70))"}


@pytest.fixture(scope="module")
def rows(spark):
    return ST.footprint_levels(spark.createDataFrame(list(WKT.items()), "path string, wkt string")).cache()


def by_path(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r.level):
        out[r.path].append(r)
    return out


def merged(cells):
    """Size of a set of (level, face, i, j) after merging."""
    cells = set(cells)
    while True:
        four = defaultdict(list)
        for c in cells:
            four[c[0] - 1, c[1], c[2] // 2, c[3] // 2].append(c)
        full = {p: x for p, x in four.items() if len(x) == 4 and p[0] >= 0}
        if not full:
            return len(cells)
        cells = (cells - {c for x in full.values() for c in x}) | set(full)


def test_refined_is_the_covering():
    for text in WKT.values():
        ring = S.ring_of(text)
        for level, area, n, flat, inner, flat_inner in C.refined(ring, 6):
            ids, centre, _ = C.grid(level)
            face, u, v = C.face_uv(centre)
            place = {k: (level, int(f), int(i), int(j)) for k, f, i, j in zip(ids.tolist(), face, np.floor(C.uv_to_st(u) * 2**level), np.floor(C.uv_to_st(v) * 2**level), strict=True)}
            cover, within = ([place[k] for k in f(ring, level)] for f in (C.covering, C.interior))
            assert (n, flat, inner, flat_inner) == (merged(cover), len(cover), merged(within), len(within))
            f, i, j = np.array([c[1:] for c in cover]).T
            corner = [C.uv_xyz(f, C.st_to_uv((i + a) / 2**level), C.st_to_uv((j + b) / 2**level)) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
            assert area == pytest.approx(S.areas(np.stack(corner, axis=1)).sum(), rel=1e-9)


def test_levels_go_on_until_the_ratio_is_met(rows):
    for path, levels in by_path(rows).items():
        assert [r.level for r in levels] == list(range(len(levels)))
        assert levels[-1].ratio < 1.05 and not any(r.cells > 5 and r.ratio < 1.05 for r in levels[:-1]), path
        for r in levels:
            assert r.bytes == 4 * r.cells and r.cells <= r.denorm_cells and r.interior_cells <= r.denorm_interior_cells <= r.denorm_cells and r.cover_area >= r.area * (1 - 1e-9)
    assert by_path(rows)["tiny"][-1].level > 14 and by_path(rows)["small"][-1].level > 7


def test_statistics_of_real_levels(rows):
    real = by_path(rows)
    every = [r for x in real.values() for r in x]
    stats = {r.level: r for r in ST.level_stats(rows).collect()}
    for level in {r.level for r in every}:
        own, s = [r for r in every if r.level == level], stats[level]
        assert (s.min_ratio, s.max_ratio, s.min_bytes, s.max_bytes, s.sum_bytes, s.n) == (min(r.ratio for r in own), max(r.ratio for r in own), min(r.bytes for r in own), max(r.bytes for r in own), sum(r.bytes for r in own), len(own))
        assert s.mean_ratio == pytest.approx(sum(r.ratio for r in own) / len(own)) and s.sum_ratio == pytest.approx(sum(r.ratio for r in own))
    stopped = by_path(ST.until_ratio(rows, 1.2))
    for path, levels in real.items():
        first = next(r.level for r in levels if r.ratio < 1.2)
        assert [r.level for r in stopped[path]] == list(range(first + 1))
    listed = rows.filter("level = 0").selectExpr("*", "1 as list_no", "cast(area * 1e15 as long) as ingest_seq")
    large = sorted((r.area, p) for p, x in real.items() for r in x[:1] if r.area > 1e-6)
    assert sorted(r.path for r in ST.sample_per_list(listed, 2, 1e-6).collect()) == sorted(p for _, p in large[:2])


def test_storage_levels_as_the_reference_breaks(rows):
    real, got = by_path(rows), by_path(ST.storage_levels(rows))
    assert [r.cells for r in real["one"][:2]] == [1, 1]
    for path, levels in real.items():
        kept, last = [], -1
        for r in levels:
            if r.cells > 5 and (last == r.cells or r.ratio < 1.05):
                break
            last = r.cells
            if r.ratio <= 2.0:
                kept.append(r.level)
        assert kept and [r.level for r in got[path]] == kept
