"""Geometry of many footprints at once against that of one, and the work that it takes."""

import numpy as np
import pytest

from swathkit.functions import cells as C
from swathkit.functions import sphere as S

BOXES = [(k * 37 % 341 - 170, k * 53 % 141 - 70, k % 7 + 2) for k in range(60)]
TEXTS = [S.write_wkt([(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]) for x, y, h in BOXES]
ODD = ["POLYGON ((0 0, 5 1, 9 0, 7 3, 9 8, 2 6))", "POLYGON((179 -1,-179 -1,-179 1,179 1,179 -1))", "POLYGON ((0 80, 120 80, 240 80, 0 80))", "POLYGON ((0 0, 0 0, 9 0, 9 9, 0 9, 0 0))", "polygon z ((0 0 1, 9 0 1, 9 9 1, 0 0 1))", "POLYGON ((180 0, -180 0, 170 9, 160 0))"]


@pytest.mark.parametrize("limits", [(8, 0, 60), (4, 0, 500), (5, 2, 10), (0, 0, 4), (9, 3, 100)])
def test_cell_unions_are_those_of_single_rings(limits):
    for at, rings in S.by_vertices(TEXTS[:30] + ODD):
        for k, cells in zip(at, C.cell_unions(rings, *limits), strict=True):
            assert cells.tolist() == C.cell_union(S.ring_of((TEXTS[:30] + ODD)[k]), *limits)


def test_coverings_are_those_of_single_rings():
    for level in (2, 4):
        for at, rings in S.by_vertices(TEXTS + ODD):
            for k, cells in zip(at, C.coverings(rings, level), strict=True):
                assert cells == C.covering(S.ring_of((TEXTS + ODD)[k]), level)


def test_texts_are_read_as_single_ones():
    texts = [*TEXTS, None, *ODD]
    found = {k: ring for at, rings in S.by_vertices(texts) for k, ring in zip(at.tolist(), rings, strict=True)}
    assert sorted(found) == [k for k, t in enumerate(texts) if t is not None]
    for k, ring in found.items():
        one = S.ring_of(texts[k])
        assert len(ring) - len(one) in (0, 1) and (len(ring) != len(one) or np.array_equal(ring, one))
    for bad in ("POLYGON ((0 0, 1 x, 1 1, 0 0))", "POLYGON ((0 0, 1))", "POINT (1 1)", "POLYGON EMPTY"):
        with pytest.raises(ValueError):
            list(S.by_vertices([TEXTS[0], bad]))


def test_cell_unions_of_suppliers_are_dealt_out(spark):
    """A table of one file is not left to one task: F2."""
    from swathkit.queries import cell_unions_hold_footprints

    plan = cell_unions_hold_footprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("RoundRobinPartitioning") > plan.index("ArrowEvalPython")
