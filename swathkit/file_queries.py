"""Queries that go through files: product lists, point files, catalogues, the stream and the command line.

Each writes what it needs from the driver's tables to a folder of its own, in the forms that users have, and reads it back
through the library; the SQL says what should come out.
"""

from __future__ import annotations

import contextlib
import io
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.cli import main
from swathkit.functions.times import literal_ms, parsed, without_fraction
from swathkit.operators.catalog import Catalog, SimpleCatalog, TextCatalog
from swathkit.plans.search import Search, with_positions
from swathkit.queries import BOX, BOX_SQL, DUMP_SQL, M0, M1, NAMES, PRODUCTS_SQL, REGION_SQL, REGION_WKT, WKT_SQL, intersects_sql, load, products, query, scan_sql, with_box
from swathkit.sources.files import Files
from swathkit.sources.points import read_points, records
from swathkit.sources.products import bad_lines, dump_line, dump_lines, in_minutes, read_products, write_dump
from swathkit.streaming.pending import ingest

YEAR = Search("year").with_dates("1997-01-01", "1997-12-31").with_time_rule("overlap")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a temporary one only for local masters. It goes when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = Path(tempfile.gettempdir(), "swathkit-files").as_uri()
    path = f"{root.rstrip('/')}/swathkit-files/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def stored(rows: DataFrame, path: str) -> DataFrame:
    """Rows that are used several times, written once and read back."""
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def text_file(lines: DataFrame, path: str, header: str = "") -> str:
    """Lines (column value, in the order of column k) as one text file: written by many tasks, in stretches of k, and joined by their names."""
    files = Files(lines.sparkSession)
    lines.orderBy("k").select("value").write.text(f"{path}.parts")
    parts = [f"{path}.parts/{n}" for n in files.names(f"{path}.parts", "part-")]
    if header:
        files.write(f"{path}.head", header.encode())
    files.concat(([f"{path}.head"] if header else []) + parts, path)
    files.delete(f"{path}.parts")
    return path


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """k and a list line of each order: times with and without fractions, spelt as none, missing, or no times at all."""
    o = with_box(load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate"))
    k, ts = F.col("k"), F.col("o_orderdate")
    end = F.timestamp_seconds(F.unix_seconds(ts.cast("timestamp")) + k % 1000 * 61)
    start = F.when(k % 11 == 0, "soon").when(k % 7 == 0, "NULL").otherwise(F.concat(iso(ts), F.when(k % 3 == 0, ".250").when(k % 3 == 1, "Z").otherwise("")))
    last = F.when(k % 5 == 0, "").otherwise(iso(end))
    return o.select("k", F.concat_ws("\t", F.concat(F.lit("L"), k.cast("string")), start, last, "wkt", F.lit("more")).alias("value"))


LINES_SQL = f"""WITH l0 AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN epoch_ms(o_orderdate) END AS a,
   CASE WHEN o_orderkey % 5 <> 0 THEN epoch_ms(o_orderdate) + o_orderkey % 1000 * 61000 END AS b FROM orders),
 l AS (SELECT 'L' || k AS path, floor(coalesce(a, b) / 60000)::INTEGER AS start_min, ceil(coalesce(b, a) / 60000)::INTEGER AS end_min, k, {WKT_SQL} AS wkt FROM (SELECT *, {BOX_SQL} FROM l0) WHERE k % 11 <> 0)"""


@query("list_read", f"{LINES_SQL} SELECT path, start_min, end_min, wkt FROM l")
def list_read(spark, d):
    path = folder(spark, "list")
    order_lines(spark, d).select("value").write.text(f"{path}/many")  # a folder of files
    return in_minutes(read_products(spark, f"{path}/many")).select("path", "start_min", "end_min", "wkt")


@query("list_order", f"{LINES_SQL} SELECT path, row_number() OVER (ORDER BY k) AS place FROM l")
def list_order(spark, d):
    """Places of lines ascend with the lines, and none is taken twice."""
    at = folder(spark, "list")
    path = text_file(order_lines(spark, d), f"{at}/one.csv")
    read_products(spark, path).select("path", "ingest_seq", F.lit(None).cast("int").alias("start_min")).write.parquet(f"{at}/read")  # numbering takes passes
    return with_positions(spark.read.parquet(f"{at}/read")).select("path", (F.col("pid") + 1).cast("long").alias("place"))  # no task has all lines


@query("list_bad_lines", "SELECT 'L' || o_orderkey AS path FROM orders WHERE o_orderkey % 11 = 0")
def list_bad_lines(spark, d):
    path = text_file(order_lines(spark, d), f"{folder(spark, 'list')}/one.csv")
    return bad_lines(spark, path).select(F.split("line", "\t")[0].alias("path"))


@query("list_ends_at_blank", "SELECT 'S' || s_suppkey AS path FROM supplier WHERE s_suppkey <= (SELECT count(*) // 2 FROM supplier)")
def list_ends_at_blank(spark, d):
    s = load(spark, d, "supplier")
    half = s.agg(F.floor(F.count("*") / 2).cast("long")).scalar()
    line = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("\tnull\t\tPOLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"))
    lines = s.select((F.col("s_suppkey") * 2).alias("k"), line.alias("value")).unionByName(s.filter(F.col("s_suppkey") == half).select((half * 2 + 1).alias("k"), F.lit("").alias("value")))
    return read_products(spark, text_file(lines, f"{folder(spark, 'list')}/one.csv")).select("path")


@query("list_empty_file", "SELECT 0::BIGINT AS n")
def list_empty_file(spark, d):
    path = folder(spark, "list")
    Files(spark).write(f"{path}/none.csv", b"")
    return read_products(spark, f"{path}/none.csv").agg(F.count("*").alias("n"))


@query("dump_round_trip", f"{PRODUCTS_SQL} SELECT path, start_min, end_min, wkt FROM p")
def dump_round_trip(spark, d):
    path = f"{folder(spark, 'dump')}/dump"
    write_dump(products(spark, d), path)
    return in_minutes(read_products(spark, path)).select("path", "start_min", "end_min", "wkt")


def catalogue(spark: SparkSession, d: str, name: str) -> Catalog:
    """Orders with even keys in the catalogue, by two updates; those that three divides in a pending list, dated a day later; suppliers in another."""
    at = folder(spark, name)
    lists = stored(products(spark, d).select("path", "start_min", "end_min", "wkt", "k"), f"{at}/products")
    later = lists.withColumns({"start_min": F.col("start_min") + 1440, "end_min": F.col("end_min") + 1440})
    c = Catalog(spark, f"{at}/catalogue")
    for k, part in enumerate((lists.filter("path LIKE 'O%' AND k % 4 = 0"), lists.filter("path LIKE 'O%' AND k % 2 = 0"))):
        c.update([text_file(part.select("k", dump_line().alias("value")), f"{at}/{k}.csv")])
    for k, part in enumerate((later.filter("path LIKE 'O%' AND k % 3 = 0"), lists.filter("path LIKE 'S%'"))):
        text_file(part.select("k", dump_line().alias("value")), f"{c.folder}/scan.{k}")
    c.files.delete(f"{at}/products")
    return c


SOURCES_SQL = f"""{PRODUCTS_SQL}, c1 AS (SELECT * FROM p WHERE path LIKE 'O%' AND k % 2 = 0),
 c2 AS (SELECT * REPLACE (start_min + 1440 AS start_min, end_min + 1440 AS end_min) FROM p WHERE path LIKE 'O%' AND k % 3 = 0), c3 AS (SELECT * FROM p WHERE path LIKE 'S%'),
 c AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3)"""
IN_YEAR = f"(start_min IS NULL OR (start_min < {M1 + 480960} AND end_min >= {M0}))"


@query("catalog_query", f"{SOURCES_SQL}, g AS (SELECT *, {BOX} FROM c WHERE {IN_YEAR}) SELECT DISTINCT path FROM g WHERE {intersects_sql(NAMES, REGION_SQL)}")
def catalog_query(spark, d):
    return catalogue(spark, d, "query").query(YEAR.with_region(REGION_WKT))


@query("catalog_without_index", f"{SOURCES_SQL}, g AS (SELECT *, {BOX} FROM c WHERE {IN_YEAR}) SELECT DISTINCT path FROM g WHERE {intersects_sql(NAMES, REGION_SQL)}")
def catalog_without_index(spark, d):
    c = catalogue(spark, d, "plain")
    return Catalog(spark, c.folder, use_index=False).query(YEAR.with_region(REGION_WKT))


@query("catalog_limit_per_source", f"""{SOURCES_SQL} SELECT DISTINCT path FROM (SELECT path, row_number() OVER (PARTITION BY s ORDER BY start_min NULLS FIRST, s = 1 AND k % 4 <> 0, k) AS r FROM
 (SELECT *, 1 AS s FROM c1 UNION ALL SELECT *, 2 FROM c2 UNION ALL SELECT *, 3 FROM c3)) WHERE r <= 20""")  # fmt: skip
def catalog_limit_per_source(spark, d):
    return catalogue(spark, d, "limit").query(Search().with_limit(20))


@query("catalog_limit_global", f"{SOURCES_SQL} SELECT path FROM c GROUP BY path ORDER BY min(start_min) NULLS FIRST, path LIMIT 20")
def catalog_limit_global(spark, d):
    return catalogue(spark, d, "global").query(Search().with_limit(20), "global")


@query("catalog_dump", f"{SOURCES_SQL} SELECT {DUMP_SQL} FROM c")
def catalog_dump(spark, d):
    return catalogue(spark, d, "dump").dump()


@query("catalog_steps", f"""{SOURCES_SQL} SELECT 2 AS version, (SELECT count(*) FROM c1) AS size, 2::BIGINT AS pending, (SELECT count(*) FROM c2) + (SELECT count(*) FROM c3) AS read,
 3 AS new_version, (SELECT count(DISTINCT path) FROM c) AS new_size, 0::BIGINT AS new_pending, 3::BIGINT AS archived, 0::BIGINT AS read_again""")  # fmt: skip
def catalog_steps(spark, d):
    """What updates count: lists read and archived, sizes, versions; a second update has nothing to do."""
    c = catalogue(spark, d, "steps")
    before = (c.version, c.size(), len(c.pending()))
    read = c.update()
    after = (c.version, c.size(), len(c.pending()), len(c.files.names(f"{c.folder}/attic")), c.update())
    return spark.createDataFrame([(*before, read, *after)], "version int, size long, pending long, read long, new_version int, new_size long, new_pending long, archived long, read_again long")


@query("catalog_first_wins", f"{SOURCES_SQL} SELECT path, start_min FROM c1 UNION ALL SELECT path, start_min FROM c2 WHERE k % 2 <> 0 UNION ALL SELECT path, start_min FROM c3")
def catalog_first_wins(spark, d):
    c = catalogue(spark, d, "first")
    c.update()
    return c.products().select("path", "start_min")


@query("catalog_states", "SELECT * FROM (VALUES ('closed', 'RuntimeError'), ('missing', '0'), ('missing, strict', 'FileNotFoundError'), ('no search', 'ValueError'), ('other level', 'ValueError'), ('text list, update', 'RuntimeError')) t(state, result)")
def catalog_states(spark, d):
    """What catalogues that cannot answer do."""
    at = folder(spark, "states")
    line = "P\t2005-01-01T00:00:00\t\tPOLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))\n".encode()

    def listed(name: str) -> str:
        Files(spark).write(f"{at}/{name}.csv", line)
        return f"{at}/{name}.csv"

    def other_level() -> int:
        Catalog(spark, f"{at}/levels", level=3).update([listed("a")])
        return Catalog(spark, f"{at}/levels", level=5).update([listed("b")])

    def closed() -> int:
        with Catalog(spark, f"{at}/none") as c:
            pass
        return c.query(Search()).count()

    cases = {
        "closed": closed, "missing": lambda: Catalog(spark, f"{at}/none").query(Search()).count(), "missing, strict": lambda: SimpleCatalog(spark, f"{at}/none").query(Search()).count(),
        "no search": lambda: Catalog(spark, f"{at}/none").query(None).count(), "other level": other_level, "text list, update": lambda: TextCatalog(spark, listed("c")).update(),
    }
    rows = []
    for name, use in cases.items():
        try:
            rows.append((name, str(use())))
        except (RuntimeError, ValueError, FileNotFoundError) as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "state string, result string")


@query("text_catalog", f"{PRODUCTS_SQL}, {scan_sql(M0, M1)} SELECT path FROM hit")
def text_catalog(spark, d):
    path = f"{folder(spark, 'text')}/dump"
    write_dump(products(spark, d), path)
    return TextCatalog(spark, path).query(Search().with_dates("1997-01-01", "1997-01-31"))


@query("stream_lists", f"{LINES_SQL} SELECT path, start_min, end_min FROM l")
def stream_lists(spark, d):
    """Lists as a stream, one file a micro-batch or more, into a catalogue; a restart adds nothing twice."""
    at = folder(spark, "stream")
    c = Catalog(spark, f"{at}/catalogue")
    order_lines(spark, d).filter("k % 2 = 0").select("value").write.text(f"{at}/in")
    ingest(spark, f"{at}/in", c, f"{at}/checkpoint").awaitTermination()
    order_lines(spark, d).select("value").write.mode("append").text(f"{at}/in")
    ingest(spark, f"{at}/in", c, f"{at}/checkpoint").awaitTermination()
    return c.products().select("path", "start_min", "end_min")


@query("stream_bad_lines", "SELECT 'L' || o_orderkey AS path FROM orders WHERE o_orderkey % 11 = 0")
def stream_bad_lines(spark, d):
    at = folder(spark, "bad")
    order_lines(spark, d).select("value").write.text(f"{at}/in")
    ingest(spark, f"{at}/in", Catalog(spark, f"{at}/catalogue"), f"{at}/checkpoint").awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").text(f"{at}/catalogue/bad_lines").select(F.split("value", "\t")[0].alias("path"))


POINT_SQL = "e AS (SELECT event_id AS k, ts, event_type, value, (user_id * 7 + event_id * 13) % 340 - 169.5 AS lon, (event_id * 11) % 140 - 69.5 AS lat FROM events)"


def point_rows(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    lon = F.pmod(F.col("user_id") * 7 + F.col("event_id") * 13, F.lit(340)) - F.lit(169.5)
    lat = F.pmod(F.col("event_id") * 11, F.lit(140)) - F.lit(69.5)
    return e.select(F.col("event_id").alias("k"), "ts", "event_type", "value", lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


@query("point_file", f"WITH {POINT_SQL} SELECT epoch_ms(date_trunc('second', ts)) AS time_ms, lon::DOUBLE AS lon, lat::DOUBLE AS lat FROM e WHERE k % 10 <> 0")
def point_file(spark, d):
    """The usual form: tabs, names in any case, comments and blank lines between rows, short rows."""
    p = point_rows(spark, d)
    line = F.concat_ws("\t", F.col("lat").cast("string"), F.col("lon").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    line = F.when(F.col("k") % 10 == 0, F.when(F.col("k") % 20 == 0, "# a note").otherwise("")).otherwise(line)
    path = text_file(p.select("k", line.alias("value")), f"{folder(spark, 'points')}/points.tsv", "Latitude\tEASTING\tTime\tname\n")
    return records(spark, path).select("time_ms", "lon", "lat")


@query("point_file_parameters", f"WITH {POINT_SQL} SELECT epoch_ms(date_trunc('hour', ts)) AS time_ms, lon::DOUBLE AS lon, lat::DOUBLE AS lat FROM e")
def point_file_parameters(spark, d):
    """Parameters before the header, after more comments than any head: separator, columns by name, a time in two columns."""
    p = point_rows(spark, d)
    line = F.concat_ws(";", F.col("event_type"), F.date_format("ts", "yyyy-MM-dd"), F.col("lon").cast("string"), F.hour("ts").cast("string"), F.col("lat").cast("string"))
    head = "#columnSeparator=;\n#latColumn=y\n#lonColumn=X\n#timeColumns=day,hour\n#dateFormat=yyyy-MM-dd,H\n" + "# a note\n" * 1200 + "kind;day;x;hour;Y\n"
    path = text_file(p.select("k", line.alias("value")), f"{folder(spark, 'points')}/points.csv", head)
    return records(spark, path).select("time_ms", "lon", "lat")


@query("point_file_columns", f"WITH {POINT_SQL} SELECT k::DOUBLE AS k, CASE WHEN k % 6 = 1 THEN 'nan' WHEN k % 6 = 2 THEN 'inf' WHEN k % 6 = 3 THEN 'none' ELSE (k % 100 / 4.0)::DOUBLE::BIGINT::VARCHAR END AS kind, event_type AS name FROM e")
def point_file_columns(spark, d):
    """Types of other columns: numbers by their first value, with later texts as NaN; empty is none."""
    p, k = point_rows(spark, d), F.col("k")
    value = F.when(k == 0, "0").when(k % 6 == 1, "words").when(k % 6 == 2, "Infinity").when(k % 6 == 3, "").otherwise((k % 100 / 4).cast("string"))
    line = F.concat_ws("\t", F.lit("1"), F.lit("2"), k.cast("string"), value, "event_type")
    first = "0\t0\t-1\t1.5\tfirst\n"
    path = text_file(p.select("k", line.alias("value")), f"{folder(spark, 'points')}/points.tsv", "lat\tlon\tk\tv\tname\n" + first)
    rows, _ = read_points(spark, path)
    v = F.col("v")
    kind = F.when(v.isNull(), "none").when(F.isnan(v), "nan").when(v == float("inf"), "inf").otherwise(F.rint(v).cast("long").cast("string"))
    return rows.filter("k >= 0").select("k", kind.alias("kind"), "name")


@query("point_file_header", "SELECT * FROM (VALUES ('description', 'columns for lat=\"Northing\" lon=\"Long\" time=\"DATE\"'), ('no location', 'ValueError'), ('no such column', 'ValueError'), ('times without format', 'ValueError'), ('no header', 'ValueError'), ('place of v', '3'), ('place of V', '-1')) t(part, result)")
def point_file_header(spark, d):
    at = folder(spark, "headers")

    def header(text: str):
        name = f"{at}/{uuid.uuid4().hex}.tsv"
        Files(spark).write(name, text.encode())
        return read_points(spark, name)[1], name

    cases = {
        "description": lambda: header("Northing\tLong\tDATE\tv\n1\t2\t\t\n")[0].description(), "no location": lambda: records(spark, header("a\tb\n1\t2\n")[1]).count(),
        "no such column": lambda: header("#latColumn=z\nlat\tlon\n1\t2\n"), "times without format": lambda: header("#timeColumns=a,b\nlat\tlon\ta\tb\n1\t2\t3\t4\n"), "no header": lambda: header("# nothing\n\n"),
        "place of v": lambda: header("lat\tlon\tt\tv\n")[0].index("v"), "place of V": lambda: header("lat\tlon\tt\tv\n")[0].index("V"),
    }
    rows = []
    for name, use in cases.items():
        try:
            rows.append((name, str(use())))
        except ValueError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "part string, result string")


@query("point_file_bad_places", "SELECT * FROM (VALUES ('lat 91', 'fails'), ('lon -181', 'fails'), ('lon 361', 'fails'), ('lon 360', '1'), ('no lat', 'fails'), ('lat nan', '1')) t(place, result)")
def point_file_bad_places(spark, d):
    at = folder(spark, "places")
    rows = []
    for place, line in (("lat 91", "91\t0"), ("lon -181", "0\t-181"), ("lon 361", "0\t361"), ("lon 360", "0\t360"), ("no lat", "\t5"), ("lat nan", "nan\t5")):
        name = f"{at}/{uuid.uuid4().hex}.tsv"
        Files(spark).write(name, f"lat\tlon\n{line}\n".encode())
        try:
            rows.append((place, str(len(records(spark, name).collect()))))
        except Exception as e:
            if "out of range or missing" not in str(e):
                raise
            rows.append((place, "fails"))
    return spark.createDataFrame(rows, "place string, result string")


@query("time_texts", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN epoch_ms(o_orderdate) WHEN 1 THEN epoch_ms(o_orderdate) WHEN 2 THEN epoch_ms(o_orderdate) END AS ms,
 CASE o_orderkey % 6 WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN 'a.b' WHEN 4 THEN '.5' END AS whole FROM orders""")  # fmt: skip
def time_texts(spark, d):
    """Time texts with and without fractions, spelt as none, or no times; and what is before a last dot."""
    k, ts = F.col("o_orderkey") % 6, iso(F.col("o_orderdate"))
    text = F.when(k == 0, ts).when(k == 1, F.concat(ts, F.lit(".123456"))).when(k == 2, F.concat(ts, F.lit("Z"))).when(k == 3, "a.b.c").when(k == 4, ".5").otherwise("Null")
    whole = F.when(k.isin(1, 3, 4), without_fraction(text))
    return load(spark, d, "orders").select("o_orderkey", parsed(text).alias("ms"), whole.alias("whole"))


@query("search_texts", """SELECT * FROM (VALUES ('date', '852076800000'), ('date and time', '852098399000'), ('empty', 'None'), ('null', 'None'), ('end day', '[1997-01-01T00:00:00, 1997-01-31T00:00:00]'),
 ('none', '[null, null]'), ('point', 'ValueError'), ('parts', 'ValueError'), ('unknown rule', 'ValueError'), ('delta -1', 'None'), ('points add up', '3'), ('start only', 'True')) t(part, result)""")  # fmt: skip
def search_texts(spark, d):
    """How searches are built and written."""
    cases = {
        "date": lambda: literal_ms("1997-01-01"), "date and time": lambda: literal_ms("1997-01-01T05:59:59"), "empty": lambda: literal_ms(""), "null": lambda: literal_ms("null"),
        "end day": lambda: str(Search().with_dates("1997-01-01", "1997-01-31")).split("ranges=[")[1].split("], start")[0], "none": lambda: str(Search()).split("ranges=[")[1].split("], start")[0],
        "point": lambda: Search().with_region("POINT (1 1)"), "parts": lambda: Search().with_region("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))"), "unknown rule": lambda: Search().with_time_rule("none"),
        "delta -1": lambda: Search().with_delta(-1).delta_ms, "points add up": lambda: len(Search().with_points([(0, 1, 1)]).with_points([(None, 2, 2), (5, 3, 3)]).points), "start only": lambda: Search().with_start_only().start_only,
    }
    rows = []
    for name, use in cases.items():
        try:
            rows.append((name, str(use())))
        except ValueError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "part string, result string")


def _said(spark: SparkSession, *args: str) -> tuple[int, list[str]]:
    out = io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(io.StringIO()):
        code = main(list(args), spark)
    return code, out.getvalue().splitlines()


@query("command_line", f"""{PRODUCTS_SQL}, s AS (SELECT path, wkt FROM p WHERE path LIKE 'S%') SELECT 'update' AS mode, 0 AS code, (SELECT count(*)::VARCHAR FROM s) AS line UNION ALL SELECT 'query', 0, path FROM s
 UNION ALL SELECT 'dump', 0, path || chr(9) || 'null' || chr(9) || 'null' || chr(9) || wkt FROM s UNION ALL SELECT m, 1, NULL FROM (VALUES ('no such mode'), ('odd arguments'), ('unknown key'), ('none')) t(m)""")  # fmt: skip
def command_line(spark, d):
    """The command line over a list of suppliers."""
    at = folder(spark, "cli")
    s = products(spark, d).filter("path LIKE 'S%'")
    path = text_file(dump_lines(s).withColumn("k", F.monotonically_increasing_id()), f"{at}/list.csv")
    c = f"{at}/catalogue"
    runs = {"update": ["update", c, path], "query": ["query", c, "startTime", "1997-01-01", "endTime", "1997-01-31"], "dump": ["dump", c], "no such mode": ["create", c], "odd arguments": ["query", c, "startTime"], "unknown key": ["query", c, "colour", "red"], "none": []}
    rows = []
    for mode, args in runs.items():
        code, lines = _said(spark, *args)
        rows += [(mode, code, x) for x in (lines or [None])]
    return spark.createDataFrame(rows, "mode string, code int, line string")


@query("point_windows_from_file", f"WITH {POINT_SQL} SELECT count(*) AS n, min(floor((epoch_ms(date_trunc('second', ts)) - 10800000) / 60000))::INTEGER AS lo, max(ceil((epoch_ms(date_trunc('second', ts)) + 10800000) / 60000))::INTEGER AS hi FROM e")
def point_windows_from_file(spark, d):
    """A point file's records as windows of three hours."""
    from swathkit.plans.matchup import windows

    p = point_rows(spark, d)
    line = F.concat_ws("\t", F.col("lat").cast("string"), F.col("lon").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    path = text_file(p.select("k", line.alias("value")), f"{folder(spark, 'points')}/points.tsv", "lat\tlon\ttime\n")
    return windows(records(spark, path), Search().with_delta(3 * 3_600_000)).agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query("files_through_hadoop", "SELECT * FROM (VALUES ('a.txt', '3'), ('b.txt', '5'), ('joined', 'one two '), ('left', 'b.txt,joined'), ('missing', 'False')) t(part, result)")
def files_through_hadoop(spark, d):
    """Whole-file operations of catalogues: write over, read, join, rename, delete, list."""
    files, at = Files(spark), folder(spark, "files")
    files.write(f"{at}/x.txt", b"something else")
    files.write(f"{at}/x.txt", b"one ")
    files.write(f"{at}/b.txt", b"two ")
    files.concat([f"{at}/x.txt", f"{at}/b.txt"], f"{at}/joined")
    files.rename(f"{at}/x.txt", f"{at}/deeper/a.txt")
    rows = [("a.txt", str(len(files.read(f"{at}/deeper/a.txt").strip()))), ("b.txt", str(len(files.read(f"{at}/b.txt")) + 1)), ("joined", files.read(f"{at}/joined").decode())]
    files.delete(f"{at}/deeper")
    rows += [("left", ",".join(n for n in files.names(at) if not n.startswith("."))), ("missing", str(files.exists(f"{at}/deeper/a.txt")))]
    return spark.createDataFrame(rows, "part string, result string")

