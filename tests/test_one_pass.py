"""Work that grows with the tables is done once a row: plans of queries over all products, and the pairs that coverings compare."""

import re

import numpy as np
import pyarrow as pa

from swathkit.functions import cells as C
from swathkit.functions import sphere as S
from swathkit.queries import QUERIES

BOXES = [(k * 37 % 341 - 170, k * 53 % 141 - 70, k % 7 + 2) for k in range(200)]
TEXTS = [S.write_wkt([(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]) for x, y, h in BOXES]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_compared_with_few_cells(monkeypatch):
    """Most cells are settled by caps inside and round a ring: F11."""
    pairs = []
    monkeypatch.setattr(S.Edges, "away", lambda self, ring, points, own=S.Edges.away: (pairs.append(len(ring)), own(self, ring, points))[1])
    cells = sum(len(x) for _, rings in S.by_vertices(TEXTS) for x in C.covered(rings))
    assert sum(pairs) < cells


def test_geometry_reads_a_text_once(spark, sf_dir):
    """Cells and bounds come from one function: F7."""
    plan = plan_of(QUERIES["footprint_bounds"](spark, sf_dir))
    assert re.findall(r"ArrowEvalPython \[(.*?)\], \[", plan) and all(x.count("run(") == 1 for x in re.findall(r"ArrowEvalPython \[(.*?)\], \[", plan))


def test_geometry_of_odd_texts_and_nulls(spark):
    texts = [TEXTS[0], None, "polygon((0 0,9 1e0,9 9))", TEXTS[1], "POLYGON ((0 0, 0 0, 9 0, 9 9, 0 9, 0 0))", "POLYGON ((0 0, 10 0, +10 10, 0 10, 0 0))"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1)
    for r in df.select("k", "t", C.wkt_geometry(df.t).alias("g"), C.wkt_covering(df.t).alias("c"), S.wkt_bounds(df.t).alias("b")).collect():
        if r.t is None:
            assert r.g.cells is None and r.c is None and r.g.lat_lo is None and r.b.lat_lo is None
        else:
            ring = S.ring_of(r.t)
            assert r.g.cells == r.c == C.covering(ring) and tuple(r.g[1:]) == tuple(r.b) and np.allclose(tuple(r.b), S.bounds(ring), rtol=0, atol=1e-12)


def test_arrow_texts_are_read_as_python_ones(monkeypatch):
    texts = pa.array([*TEXTS, None])
    fast = {k: r for at, rings in S.by_vertices(texts) for k, r in zip(at.tolist(), rings, strict=True)}
    monkeypatch.setattr(S, "_numbers", lambda t: ([], np.flatnonzero(t.is_valid().to_numpy(zero_copy_only=False))))
    slow = {k: r for at, rings in S.by_vertices(texts) for k, r in zip(at.tolist(), rings, strict=True)}
    assert set(fast) == set(slow) == set(range(len(TEXTS))) and all(np.array_equal(fast[k], slow[k]) for k in fast)


def test_products_are_derived_once(spark, sf_dir):
    """One pass tells pruned and unpruned: F8; corners are not exploded and gathered again: F12."""
    assert plan_of(QUERIES["pruned_equals_unpruned"](spark, sf_dir)).count("lineitem.parquet") == 1
    plan = plan_of(QUERIES["coverings_hold_footprints"](spark, sf_dir))
    assert "Generate" not in plan and plan.count("HashAggregate") == 2  # of lines by order alone


def test_lines_are_split_once(spark, tmp_path):
    """Fields come from a generator, so that filters and columns do not split a line again: F13, F15."""
    from swathkit.sources.products import in_minutes, read_products

    (tmp_path / "a.csv").write_text("P\t2005-01-01T00:00:00\t\tPOLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))\nQ\tsoon\t\tx\n")
    read = in_minutes(read_products(spark, f"{tmp_path}/a.csv"))
    filters = [x for x in read._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x and "gettimestamp" in x.lower()]
    assert filters and not any("split(" in x for x in filters)
    assert [r.path for r in read.collect()] == ["P"]


def test_catalogues_are_made_of_stored_products(spark, sf_dir, monkeypatch):
    """Products are derived once for all lists of a catalogue, and for all searches: F5, F16, F17, F18, F19, F20."""
    from swathkit import file_queries as Q

    plans = []
    monkeypatch.setattr(Q, "text_file", lambda lines, path, own=Q.text_file: (plans.append(plan_of(lines)), own(lines, path))[1])
    c = Q.catalogue(spark, sf_dir, "once")
    assert len(plans) == 4 and not any("lineitem.parquet" in p for p in plans)
    assert c.files.names(c.folder.rsplit("/", 1)[0]) == ["catalogue"]
    assert "lineitem.parquet" not in plan_of(QUERIES["benchmark_searches"](spark, sf_dir))


def test_only_found_rows_are_sampled(spark, sf_dir):
    """The order of a text catalogue's result is made of what was found, not of the list read again: F21."""
    plan = QUERIES["text_catalog"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Sort [") < plan.index("RepartitionByExpression [ingest_seq")
