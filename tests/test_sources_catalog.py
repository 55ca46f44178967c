"""Lists, point files, catalogues, the stream and the command line."""

import pytest

from swathkit.cli import main
from swathkit.operators.catalog import Catalog, SimpleCatalog, TextCatalog
from swathkit.plans.search import Search
from swathkit.sources.points import read_header, read_points, records
from swathkit.sources.products import bad_lines, in_minutes, read_products
from swathkit.streaming.pending import ingest

BOX = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"


def write(path, rows):
    path.write_text("".join("\t".join(r) + "\n" for r in rows))
    return str(path)


def products(prefix, days):
    return [(f"{prefix}{n}", f"2005-01-0{n}T10:00:30.5", f"2005-01-0{n}T12:00:30", BOX) for n in days]


def test_product_list(spark, tmp_path):
    path = write(tmp_path / "a.csv", [*products("p", [1]), ("q", "", "2005-01-02T00:00:00Z", BOX, "more"), ("bad", "soon", "", BOX), ("r", "null", "", BOX), ("",), *products("z", [2])])
    rows = {r.path: (r.start_min, r.end_min) for r in in_minutes(read_products(spark, path)).collect()}
    assert set(rows) == {"p1", "q", "r"}
    assert rows["p1"][1] - rows["p1"][0] == 121 and rows["r"] == (None, None) and rows["q"][0] == rows["q"][1]
    assert [r.line.split("\t")[0] for r in bad_lines(spark, path).collect()] == ["bad"]
    assert {r.path for r in read_products(spark, path, stop_at_blank=False).collect()} == {"p1", "q", "r", "z2"}
    with pytest.raises(Exception, match="fewer than four fields"):
        read_products(spark, write(tmp_path / "b.csv", [("p", "x")])).collect()


def test_point_file(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("#columnSeparator=;\n#latColumn=y\n#lonColumn=x\n#timeColumns=d,h\n#dateFormat=yyyy-MM-dd,H\ny;x;d;h;v;name\n# note\n\n1.5;2;2005-01-02;3;nan;a\n-1;360;2005-01-03;4;x\n")
    rows, header = read_points(spark, str(f))
    got = rows.orderBy("rec_id").collect()
    assert header.has_time and header.time == [2, 3] and [r.name for r in got] == ["a", None]
    assert got[0].v != got[0].v and got[1].v != got[1].v and got[1].x == 360
    assert [(r.lat, r.lon) for r in records(spark, str(f)).orderBy("rec_id").collect()] == [(1.5, 2.0), (-1.0, 360.0)]
    f.write_text("Northing\tEASTING\tDate\n91\t0\t2005-01-01 00:00:00\n")
    with pytest.raises(Exception, match="latitude"):
        records(spark, str(f)).collect()
    assert read_header(["lat\tlon\ttime"]).time == [2]
    with pytest.raises(ValueError, match="dateFormat"):
        read_header(["#timeColumns=a,b", "a\tb\tlat\tlon"])
    f.write_text("latitude\tlong\n1\t2\n")
    assert records(spark, str(f)).first().time_ms is None


def test_safe_catalog(spark, tmp_path):
    folder = tmp_path / "cat"
    folder.mkdir()
    c = Catalog(spark, str(folder))
    assert c.size() == 0 and c.query(Search()).count() == 0 and c.update() == 0
    assert c.update([write(tmp_path / "1.csv", products("p", [1, 2]))]) == 2 and c.version == 1
    write(folder / "scan.2", [*products("p", [2, 3]), *products("p", [3])])
    assert c.query(Search().with_dates("2005-01-03")).count() == 1  # pending lists are searched
    assert c.dump().count() == 5
    assert c.update() == 3 and c.version == 2 and c.size() == 3 and not c.pending()
    assert c.update([write(tmp_path / "3.csv", products("p", [4]))]) == 1 and c.size() == 4
    assert sorted(p.name for p in folder.iterdir() if p.name.startswith("v")) == ["v1", "v2", "v3"]
    assert len(list((folder / "attic").glob("scan.*"))) == 3 and not (tmp_path / "1.csv").exists()
    assert [r[0] for r in c.query(Search().with_region(BOX).with_limit(2)).collect()] == ["p1", "p2"]
    (folder / "v4").mkdir()
    (folder / "v4" / "part-left-by-a-crash").write_text("x")
    assert c.size() == 4 and c.update([write(tmp_path / "5.csv", products("p", [5]))]) == 1 and c.size() == 5
    with pytest.raises(FileNotFoundError):
        Catalog(spark, str(tmp_path / "none"), fail_if_missing=True).size()


def test_parts_are_merged_and_old_ones_go(spark, tmp_path):
    folder = tmp_path / "cat"
    c = Catalog(spark, str(folder))
    for n in range(1, 12):
        assert c.update([write(tmp_path / "l.csv", [(f"m{n}", f"2006-02-{n:02}T01:00:00", "", BOX), ("m1", "", "", BOX)])]) == 2
        assert c.size() == n
    kept = sorted(int(p.name[1:]) for p in folder.iterdir() if p.name.startswith("v"))
    assert c.version == 12 and kept == [10, 11, 12]  # the ninth update wrote all as one part, v10
    assert [r[0] for r in c.query(Search()).collect()] == [f"m{n}" for n in range(1, 12)]
    assert c.products().select("ingest_seq").distinct().count() == 11


def test_level_belongs_to_the_catalogue(spark, tmp_path):
    folder = str(tmp_path / "cat")
    Catalog(spark, folder, level=3).update([write(tmp_path / "1.csv", products("p", [1]))])
    region = Search().with_region("POLYGON ((2 2, 4 2, 4 4, 2 4, 2 2))")
    for c in (Catalog(spark, folder), Catalog(spark, folder, level=6), Catalog(spark, folder, level=3)):
        assert c.level == 3 and [r[0] for r in c.query(region).collect()] == ["p1"]
        assert [r[0] for r in c.query(Search().with_points([(None, 5, 5)])).collect()] == ["p1"]
    with pytest.raises(ValueError, match="level 3"):
        Catalog(spark, folder, level=6).update([write(tmp_path / "2.csv", products("p", [2]))])


def test_pointer_survives_a_crash(spark, tmp_path):
    folder = tmp_path / "cat"
    c = Catalog(spark, str(folder))
    for n in (1, 2):
        c.update([write(tmp_path / "l.csv", products("p", [n]))])
    assert not (folder / "_current.tmp").exists()
    whole = (folder / "_current").read_bytes()
    for crc in folder.glob("._current*"):
        crc.unlink()
    (folder / "_current").write_bytes(whole[:10])  # as a file system without renames would leave it
    with pytest.warns(UserWarning, match="version 2 is used"):
        assert c.size() == 2
    (folder / "v3").mkdir()  # a version that was not finished
    (folder / "v3" / "_version.json").write_text("{}")
    with pytest.warns(UserWarning, match="version 2 is used"):
        assert c.version == 2
    with pytest.warns(UserWarning):
        assert c.update([write(tmp_path / "l.csv", products("p", [3]))]) == 1
    assert c.version == 3 and c.size() == 3
    (folder / "_current").write_text('{"format": 99}')
    for crc in folder.glob("._current*"):
        crc.unlink()
    with pytest.raises(ValueError, match="format 99"):
        c.products()


def test_closed_catalogue(spark, tmp_path):
    with Catalog(spark, str(tmp_path / "cat")) as c:
        assert c.size() == 0
    for use in (lambda: c.query(Search()), c.products, lambda: c.update([write(tmp_path / "l.csv", products("p", [1]))])):
        with pytest.raises(RuntimeError, match="closed"):
            use()


def test_lists_of_a_folder(spark, tmp_path):
    """Lines of several files have different places, ascending by file name and line."""
    folder = tmp_path / "lists"
    folder.mkdir()
    for f in "cab":
        write(folder / f"{f}.csv", [(f"{f}{n}", "", "", BOX) for n in range(40)])
    rows = read_products(spark, str(folder)).collect()
    assert len({r.ingest_seq for r in rows}) == 120
    assert [r.path for r in sorted(rows, key=lambda r: r.ingest_seq)] == [f"{f}{n}" for f in "abc" for n in range(40)]
    both = read_products(spark, [str(folder / "c.csv"), str(folder / "a.csv")]).orderBy("ingest_seq").collect()
    assert [r.path[0] for r in both] == ["c"] * 40 + ["a"] * 40
    far = tmp_path / "far.csv"
    far.write_text("".join(f"# note {k}\n" for k in range(1500)) + "lat\tlon\n1\t2\n")
    assert [(r.lat, r.lon) for r in records(spark, str(far)).collect()] == [(1.0, 2.0)]


def test_simple_and_text_catalogs(spark, tmp_path):
    path = write(tmp_path / "1.csv", products("p", [1, 2]))
    s = SimpleCatalog(spark, str(tmp_path / "simple"))
    with pytest.raises(FileNotFoundError):
        s.size()
    assert s.update([path]) == 2 and s.size() == 2 and (tmp_path / "1.csv").exists()
    t = TextCatalog(spark, path)
    assert [r[0] for r in t.query(Search().with_dates("2005-01-02")).collect()] == ["p2"] and t.size() == 2
    with pytest.raises(RuntimeError):
        t.update()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.csv", products("p", [1, 2]))
    c = Catalog(spark, str(tmp_path / "cat"))
    ingest(spark, str(tmp_path / "in"), c, str(tmp_path / "cp")).awaitTermination(120)
    write(tmp_path / "in" / "b.csv", products("p", [2, 3]))
    ingest(spark, str(tmp_path / "in"), c, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.path for r in c.products().collect()) == ["p1", "p2", "p3"]
    write(tmp_path / "in" / "c.csv", [("bad", "soon", "later", BOX), ("half", "2005-01-05T00:00:00", "later", BOX), ("",), *products("q", [1])])
    ingest(spark, str(tmp_path / "in"), c, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.path for r in c.products().collect()) == ["p1", "p2", "p3", "q1"]
    assert sorted(x.split("\t")[0] for f in (tmp_path / "cat" / "bad_lines").rglob("part-*") for x in f.read_text().splitlines()) == ["bad", "half"]
    write(tmp_path / "in" / "d.csv", [("short", "")])
    with pytest.raises(Exception, match="fewer than four fields"):
        ingest(spark, str(tmp_path / "in"), c, str(tmp_path / "cp")).awaitTermination(120)


def test_command_line(spark, tmp_path, capsys):
    folder, path = str(tmp_path / "cat"), write(tmp_path / "1.csv", products("p", [1, 2]))
    assert main(["update", folder, path], spark) == 0
    capsys.readouterr()
    assert main(["query", folder, "startTime", "2005-01-02", "wkt", BOX], spark) == 0
    assert capsys.readouterr().out == "p2\n"
    points = write(tmp_path / "points.tsv", [("lat", "lon", "time"), ("5", "5", "2005-01-01 09:00:00"), ("50", "5", "2005-01-02 11:00:00")])
    assert main(["query", folder, "insitu", points], spark) == 0
    assert capsys.readouterr().out == "p1\n"
    assert main(["dump", folder], spark) == 0
    assert capsys.readouterr().out.splitlines()[0] == f"p1\t2005-01-01T10:00:00\t2005-01-01T12:01:00\t{BOX}"
    assert main(["dump", folder, str(tmp_path / "all.csv")], spark) == 0
    assert [x.split("\t")[0] for x in (tmp_path / "all.csv").read_text().splitlines()] == ["p1", "p2"] and not (tmp_path / "all.csv.parts").exists()
    assert main(["cells", "10", "42"], spark) == 0
    assert [x.split()[0] for x in capsys.readouterr().out.splitlines()] == [str(k) for k in range(14)]
    assert main(["cells", "10"], spark) == 1
    assert main(["query", folder, "startTime"], spark) == 1 and main(["create", folder], spark) == 1 and main([], spark) == 1
