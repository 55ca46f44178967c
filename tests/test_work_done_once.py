"""What must be done once, or by many tasks: plans and files of catalogues, lists and the stream."""

from swathkit.operators.catalog import Catalog
from swathkit.sources.files import Files

LINE = "P%d\t2005-01-%02dT00:00:00\t\tPOLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"


def test_geometry_is_computed_after_ranges_are_known(spark, tmp_path, monkeypatch):
    """The job that samples ranges does not compute geometry: F3."""
    import swathkit.operators.catalog as module

    below = []
    monkeypatch.setattr(module, "with_geometry", lambda rows, level, own=module.with_geometry: below.append(rows._jdf.queryExecution().analyzed().toString()) or own(rows, level))
    Files(spark).write(f"{tmp_path}/a.csv", "\n".join(LINE % (k, k % 28 + 1) for k in range(50)).encode())
    c = Catalog(spark, f"{tmp_path}/c")
    assert c.update([f"{tmp_path}/a.csv"]) == 50
    assert len(below) == 1 and below[0].index("Sort [") < below[0].index("RepartitionByExpression")
    assert c.products().filter("size(cells) > 0 AND lat_hi > 0.9").count() == 50
    starts = [r.start_min for r in c.products().select("start_min").collect()]
    assert len(starts) == 50


def test_no_task_has_a_whole_list(spark):
    """Lists are written by many tasks, in order, and numbered without a window over all lines: F9, F10."""
    from pyspark.sql import functions as F

    from swathkit.file_queries import folder, list_order, text_file

    plan = list_order(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if " Window [" in x]
    assert windows and all("ingest_seq" not in x or "_slot" in x for x in windows)
    at = f"{folder(spark, 'parts')}/one.txt"
    lines = spark.range(0, 4000, 1, 8).select((4000 - F.col("id")).alias("k"), (4000 - F.col("id")).cast("string").alias("value"))
    sizes = []
    concat, Files.concat = Files.concat, lambda self, paths, to: (sizes.append(len(paths)), concat(self, paths, to))[1]
    keep = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text_file(lines, at)
    finally:
        Files.concat = concat
        spark.conf.set("spark.sql.adaptive.enabled", keep)
    assert sizes == [4]
    assert Files(spark).read(at).decode().split() == [str(k) for k in range(1, 4001)]


def test_sources_are_not_sorted_without_a_limit_of_their_own(spark, tmp_path):
    """Only the whole result is put in order, unless each source is limited: F6."""
    from swathkit.plans.search import Search

    c = Catalog(spark, f"{tmp_path}/c")
    for k in range(2):
        Files(spark).write(f"{c.folder}/scan.{k}", "\n".join(LINE % (n, n % 28 + 1) for n in range(k * 5, k * 5 + 30)).encode())
    ranged = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Sort [")
    assert ranged(c.query(Search())) == 1
    assert ranged(c.query(Search().with_limit(3), "global")) == 1
    assert ranged(c.query(Search().with_limit(3))) == 4
    assert [r.path for r in c.query(Search().with_limit(3), "global").collect()] == ["P0", "P28", "P1"]
