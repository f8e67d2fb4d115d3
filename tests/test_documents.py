"""HTML and KML extraction, the JSON readers, geometry, and the exports."""

from __future__ import annotations

import csv
import io
import json
from pathlib import Path
import math

import pytest
from pyspark.sql import functions as F

from marshlight.functions import geo
from marshlight.operators import export
from marshlight.sources import archive, versions, html, kml

HEAD = "Ground spraying for adult insect control using Dibrom® is scheduled for the evening of Friday, July 24, 2026, between 8:40&nbsp;p.m. and 10:00 p.m."


def area(name="Area", mid="m1", extra=""):
    return f'<li><strong>{name}:</strong> &gt;North to X. {extra}<a href="https://g/u/0/edit?mid={mid}">See Map</a></li>'


def page(*parts):
    return "<html><body><div>" + "".join(parts) + "</div></body></html>"


def operation(*areas, head=HEAD):
    return f"<ul><li>{head}<ul>{''.join(areas)}</ul></li></ul>"


def extract(spark, *pages):
    rows = spark.createDataFrame([("live", k, p) for k, p in enumerate(pages)], "source string, page_ord int, html string")
    areas = html.extract_areas(rows)
    ops = html.operations(areas, F.lit("2026-01-01T00:00:00Z")).orderBy("seq").collect()
    return ops, {r.reason: r.n for r in html.rejects(areas).collect()}


def test_pages(spark):
    past = "<h2>Past Operations</h2>"
    pages = {
        "shared header": page(operation(area("A", "a"), area("B", "b"), area("C", "c"))),
        "two lists": page("<h2>Current</h2>", operation(area(mid="d")), past, operation(area(mid="e")), operation(area(mid="f"))),
        "empty list first": page("<ul><li><ul></ul>G<strong>round spraying </strong>for larvae on July 2 2026<ul>", area(mid="g"), "</ul></li></ul>"),
        "blank link first": page(operation('<li><b>X</b><a href="?mid=bad"> </a><a href="?mid=h">See Map</a></li>', '<li><b>X</b><a href="?mid=i">See Map</a><a href="?mid=bad"> </a></li>')),
        "link in name": page(operation('<li><strong><a href="?mid=j">Map</a> Name</strong>: text</li>')),
        "names": page(operation(*(f'<li>{n} text <a href="?mid=k{k}">Map</a></li>' for k, n in enumerate(("<b>N:</b>", "<b>N</b>:", "<b>N</b><b>:</b>", "<strong>N</strong> <b>:</b>", "N:"))))),
        "postponed": page(operation(area(mid="l"), head=HEAD + " POSTPONED TO MONDAY, JULY 27, 2026")),
        "rejects": page(operation("<li>no link</li>", area(mid="m")), operation(area(mid="n"), head="Ground spraying some day"), "<ul><li>" + HEAD + "</li></ul>"),
        "short headings": page("<p>Past operations</p>", operation(area(mid="o"))),
        "title between": page("<h2>Current</h2><h1>Spray Alerts</h1>", operation(area(mid="p"))),
        "nothing": page("<p>hello</p>"),
        "wrong id": page(operation(area(mid="1PG7iZX-Eb0uV_kH6VfCE37SqwMoGj00c"))),
        "status element": page(operation(area("S", "q", "<span><b>COMPLETE</b></span> "), area("T", "r", "CANCELLED. "))),
    }
    ops, rejected = extract(spark, *pages.values())
    by = {r.mid: r for r in ops}
    first = by["a"]
    assert [(by[m].area_name, by[m].date, by[m].method, by[m].time_start, by[m].time_end, by[m].products) for m in "abc"] == [(n, "2026-07-24", "ground", "20:40", "22:00", ["Dibrom"]) for n in "ABC"]
    assert first.id == "2026-07-24|a" and first.boundary_text == "North to X." and first.map_url.endswith("mid=a") and first.section is None and first.status == "scheduled"
    assert [by[m].section for m in "def"] == ["current", "past", "past"]
    assert (by["g"].method, by["g"].target, by["g"].date) == ("ground", "larval", "2026-07-02")
    assert "bad" not in by and {"h", "i", "j"} <= set(by)
    assert [by[f"k{k}"].area_name for k in range(5)] == ["N"] * 5
    assert (by["l"].status, by["l"].date) == ("postponed", "2026-07-27")
    assert "m" in by and "n" not in by and rejected == {"no_map": 1, "no_date": 1, "no_areas": 1}
    assert by["o"].section == "past" and by["p"].section == "current"
    assert "1JNoCNnTgawK0dNM7YpxQIOZZHDmI6jVQ" in by
    assert (by["q"].status, by["q"].status_text, by["q"].boundary_text) == ("complete", "COMPLETE", "North to X.")
    assert by["r"].status == "cancelled"


def test_unclosed_items_nest(spark):
    """Without an end tag an item holds the next one, so only the outer one is an operation."""
    ops, _ = extract(spark, page(f"<ul><li>{HEAD}<ul>{area(mid='a')}</ul><li>{HEAD}<ul>{area(mid='b')}</ul></ul>"))
    assert [r.mid for r in ops] == ["a"]


def ring(*points):
    return "<LinearRing><coordinates>" + " ".join(f"{x},{y},0" for x, y in points) + "</coordinates></LinearRing>"


SQUARE = [(-121.3, 37.7), (-121.2, 37.7), (-121.2, 37.8), (-121.3, 37.8), (-121.3, 37.7)]
HOLE = [(-121.28, 37.72), (-121.22, 37.72), (-121.22, 37.78), (-121.28, 37.78), (-121.28, 37.72)]


def polygon(outer, *holes):
    return f"<Polygon><outerBoundaryIs>{ring(*outer)}</outerBoundaryIs>" + "".join(f"<innerBoundaryIs>{ring(*h)}</innerBoundaryIs>" for h in holes) + "</Polygon>"


def document(body, name="<name>D4(b)- Brack</name>", ns=' xmlns="http://www.opengis.net/kml/2.2"'):
    return f"<kml{ns}><Document>{name}<Placemark><name>Polygon 1</name>{body}</Placemark></Document></kml>"


def ring_area(points):
    r = math.radians
    total = sum(r(b[0] - a[0]) * (2 + math.sin(r(a[1])) + math.sin(r(b[1]))) for a, b in zip(points, points[1:], strict=False))
    return abs(total * 6371.0088**2 / 2)


def test_kml(spark):
    cases = {
        "one": document(polygon(SQUARE)), "reversed": document(polygon(SQUARE[::-1])), "open": document(polygon(SQUARE[:3])), "line": document(polygon([SQUARE[0], SQUARE[1], SQUARE[0]])),
        "two": document("<MultiGeometry>" + polygon(SQUARE) + "</MultiGeometry>" + polygon(SQUARE)), "hole": document(polygon(SQUARE, HOLE)), "point": document("<Point><coordinates>1,2</coordinates></Point>"),
        "broken": "<kml><Document>", "unnamed": document(polygon(SQUARE), ""), "bare": document(polygon(SQUARE), ns=""), "swapped": document(polygon([(y, x) for x, y in SQUARE])), "null": None,
    }
    rows = {r.mid: r for r in kml.shapes_of_kml(spark.createDataFrame(list(cases.items()), "mid string, xml string"), F.lit("t")).collect()}
    assert {m: r.reason for m, r in rows.items() if r.reason} == {"line": "no_polygon", "point": "no_polygon", "broken": "no_polygon", "null": "no_polygon", "swapped": "out_of_bounds"}
    points = lambda r, k=0: [tuple(p) for p in r.polygons[0][k]]
    assert points(rows["one"]) == SQUARE == points(rows["bare"]) and points(rows["reversed"]) == SQUARE
    assert len(points(rows["open"])) == 4 and rows["two"].geom_type == "MultiPolygon" and rows["one"].geom_type == "Polygon"
    assert abs(rows["one"].area_sq_km - ring_area(SQUARE)) < 1e-4 and abs(rows["two"].area_sq_km - 2 * ring_area(SQUARE)) < 2e-4
    assert abs(rows["hole"].area_sq_km - ring_area(SQUARE) + ring_area(HOLE)) < 2e-4 and points(rows["hole"], 1) == HOLE[::-1]
    assert (rows["one"].doc_name, rows["one"].zone_code, rows["unnamed"].doc_name) == ("D4(b)- Brack", "D4(b)", None)


def test_coordinates_and_centroid(spark):
    flat = "array(array(array(named_struct('lon', 1D, 'lat', 2D), named_struct('lon', 3D, 'lat', 2D), named_struct('lon', 1D, 'lat', 2D))))"
    row = spark.range(1).select(geo.parse_coordinates(F.lit("-121.30, 37.77, 0 junk -121.2,x,0")).alias("p"), geo.centroid(F.expr(flat)).alias("c"), geo.centroid(F.expr(f"cast(null as {geo.POLYGONS})")).alias("n"), geo.out_of_bounds(F.expr(f"cast(array() as {geo.POLYGONS})")).alias("o")).first()
    assert [tuple(p) for p in row.p] == [(-121.3, 37.77)]
    assert (row.c.lat, row.c.lon) == (2.0, round(5 / 3, 6)) and row.n is None and row.o


def test_json_readers(spark, tmp_path):
    ops = [{"id": "a|1", "date": "2026-01-01", "products": ["Dibrom"]}, 5, {"id": "b|1", "extra": 1}]
    for name, doc in (("bare", ops), ("object", {"generated_at": "t", "operations": ops})):
        (tmp_path / name).write_text(json.dumps(doc))
        assert sorted((r.id, r.products) for r in archive.load_operations(spark, str(tmp_path / name)).collect()) == [("a|1", ["Dibrom"]), ("b|1", None)]
    assert archive.load_operations(spark, str(tmp_path / "none")).count() == 0
    for bad in ('{"x": 1}', "{broken", '{"operations": 3}'):
        (tmp_path / "bad").write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            archive.load_operations(spark, str(tmp_path / "bad")).collect()
    geometry = {"type": "Polygon", "coordinates": [[[1, 2], [3, 2], [3, 4], [1, 2]]]}
    multi = {"type": "MultiPolygon", "coordinates": [geometry["coordinates"], geometry["coordinates"]]}
    features = [{"id": "x", "properties": {"mid": "m", "doc_name": "old"}, "geometry": geometry}, {"id": "m", "properties": {"doc_name": "new"}, "geometry": multi}, {"properties": {}, "geometry": geometry}]
    for name, doc in (("list", features), ("collection", {"type": "FeatureCollection", "features": features})):
        (tmp_path / name).write_text(json.dumps(doc))
        row = archive.load_shapes(spark, str(tmp_path / name)).collect()
        assert [(r.mid, r.doc_name, r.geom_type, len(r.polygons)) for r in row] == [("m", "new", "MultiPolygon", 2)]


def test_capture_listing(spark):
    rows = spark.createDataFrame([('[["digest","timestamp","statuscode"],["d","2020","200"],["e","2021","301"]]',), ("[]",)], "raw string")
    assert [tuple(r) for r in rows.select(F.inline(archive.capture_table(F.col("raw")))).collect()] == [("2020", "200", "d", 0), ("2021", "301", "e", 1)]
    with pytest.raises(Exception, match="without digest"):
        spark.createDataFrame([('[["timestamp","statuscode"],["2020","200"]]',)], "raw string").select(F.inline(archive.capture_table(F.col("raw")))).collect()


def test_cached_pages(spark, tmp_path):
    (tmp_path / "20200101000000.html").write_bytes(b"x" * 3000 + b"\xff")
    (tmp_path / "20200102000000.html").write_text("short")
    rows = archive.cached_pages(spark, str(tmp_path)).collect()
    assert [r.source for r in rows] == ["wayback:20200101000000"] and rows[0].html.endswith("�")


@pytest.fixture
def archive_tables(spark):
    op = {c: None for c in archive.OPERATION.replace(",", "").split()[::2]} | {"products": ["Dibrom", "Altosid"], "method": "ground", "target": "adult", "status": "complete", "source": "live"}
    names = ["id", "date", "method", "target", "products", "products_raw", "period", "time_start", "time_end", "area_name", "boundary_text", "mid", "map_url", "status", "status_text", "section", "source", "first_seen"]
    rows = [op | {"id": f"2026-01-0{k}|{m}", "date": f"2026-01-0{k}", "mid": m, "area_name": a} for k, m, a in ((2, "m", 'He said "x", y'), (1, "m", "A\nB"), (3, "none", "Z"))]
    ops = spark.createDataFrame([[r.get(n) for n in names] for r in rows], archive.OPERATION)
    shapes = spark.createDataFrame([("m", "D4", 0.0001, [[[tuple(p) for p in SQUARE]]])], f"mid string, zone_code string, area_sq_km double, polygons {geo.POLYGONS}")
    return ops, shapes


def joined(folder, end):
    return "".join(p.read_bytes().decode() for p in sorted(folder.glob("part-*"))) if end is None else None


def test_csv(spark, tmp_path, archive_tables):
    export.write_csv(export.export_rows(*archive_tables), str(tmp_path / "csv"))
    text = joined(tmp_path / "csv", None)
    assert text.startswith("﻿date,method") and text.count("\r\n") == 4
    rows = list(csv.DictReader(io.StringIO(text.removeprefix("﻿"), newline="")))
    assert [(r["date"], r["area_name"], r["region"], r["area_sq_km"], r["products"], r["centroid_lat"]) for r in rows] == [
        ("2026-01-01", "A\nB", "Delta", "0.0001", "Dibrom; Altosid", "37.75"), ("2026-01-02", 'He said "x", y', "Delta", "0.0001", "Dibrom; Altosid", "37.75"), ("2026-01-03", "Z", "Unknown", "", "Dibrom; Altosid", ""),
    ]


def test_geojson(spark, tmp_path, archive_tables):
    assert export.write_geojson(*archive_tables, str(tmp_path / "g")) == 1
    doc = json.loads(joined(tmp_path / "g", None))
    assert doc["bbox"] == [-121.3, 37.7, -121.2, 37.8] and [f["id"] for f in doc["features"]] == ["2026-01-01|m", "2026-01-02|m"]
    assert doc["features"][0]["geometry"] == {"type": "Polygon", "coordinates": [[list(p) for p in SQUARE]]} and doc["features"][1]["properties"]["area_name"] == 'He said "x", y'
    assert export.write_geojson(archive_tables[0], archive_tables[1].filter("1 = 0"), str(tmp_path / "none")) == 3
    assert json.loads(joined(tmp_path / "none", None)) == {"type": "FeatureCollection", "features": []}


def test_geojson_with_repeated_ids(spark, tmp_path, archive_tables):
    """A last row that is there three times still gives a document."""
    ops, shapes = archive_tables
    export.write_geojson(ops.union(ops).union(ops.filter("mid = 'm'")), shapes, str(tmp_path / "g"))
    assert len(json.loads(joined(tmp_path / "g", None))["features"]) == 6


def test_write_if_changed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, at string")
    path = str(tmp_path / "t")
    assert export.write_if_changed(rows, path, ("at",))
    before = versions.current_table(spark, path)
    assert not export.write_if_changed(rows.orderBy(F.desc("id")).withColumn("at", F.lit("later")), path, ("at",))
    assert export.write_if_changed(rows.union(rows), path, ("at",)) and versions.current_table(spark, path).count() == 4
    assert before.count() == 2  # an open reader keeps what it read
    assert versions.forget_versions(spark, path) == 1 and versions.current_table(spark, path).count() == 4
    assert export.seed_missing(spark, str(tmp_path), str(tmp_path / "new"), ("t",)) == 1 and export.seed_missing(spark, str(tmp_path), str(tmp_path / "new"), ("t",)) == 0
    assert versions.current_table(spark, str(tmp_path / "new/t")).count() == 4


def test_versions_are_exclusive(spark, tmp_path):
    path = str(tmp_path / "v")
    versions.replace_folder(spark, path, lambda folder: spark.range(1).write.parquet(folder))
    with pytest.raises(versions.ConflictError):
        versions.publish_version(spark, path, 1, {"folder": "other"})
    with pytest.raises(ZeroDivisionError):  # a writer that dies leaves the old folder current
        versions.replace_folder(spark, path, lambda folder: 1 / 0)
    assert versions.current_table(spark, path).count() == 1
    with pytest.raises(FileNotFoundError):
        versions.current_table(spark, str(tmp_path / "none"))


def test_archive_documents(spark, tmp_path, archive_tables):
    """Written, read and compared; the parts are a JSON document in order; only the clock changes nothing."""
    ops, path = archive_tables[0], str(tmp_path / "ops")
    assert export.write_operations(ops, path, "t1") and not export.write_operations(ops.orderBy(F.desc("id")), path, "t2")
    doc = json.loads(joined(Path(versions.current_folder(spark, path)), None))
    assert doc["generated_at"] == "t1" and [o["id"] for o in doc["operations"]] == ["2026-01-01|m", "2026-01-02|m", "2026-01-03|none"]
    assert list(doc["operations"][0]) == sorted(doc["operations"][0]) and doc["operations"][0]["period"] is None
    assert sorted(map(tuple, archive.load_operations(spark, path).select("id", "area_name", "status").collect())) == sorted(map(tuple, ops.select("id", "area_name", "status").collect()))
    assert export.write_operations(ops.filter("mid = 'm'"), path, "t3") and archive.load_operations(spark, path).count() == 2
    shapes = archive_tables[1].withColumns({"geom_type": F.lit("Polygon"), "doc_name": F.lit('é "x",')})
    path = str(tmp_path / "shapes")
    assert export.write_shapes(shapes, path) and not export.write_shapes(shapes, path)
    assert [(r.mid, r.doc_name, len(r.polygons)) for r in archive.load_shapes(spark, path).collect()] == [("m", 'é "x",', 1)]
    path = str(tmp_path / "none")
    assert export.write_operations(ops.limit(0), path, "t") and archive.load_operations(spark, path).count() == 0


def test_small_documents(spark, tmp_path):
    path = str(tmp_path / "m")
    assert export.write_json({"b": [1], "a": "é", "generated_at": "1"}, spark, path) and not export.write_json({"b": [1], "a": "é", "generated_at": "2"}, spark, path)
    assert joined(Path(versions.current_folder(spark, path)), None) == '{\n  "a": "é",\n  "b": [\n    1\n  ],\n  "generated_at": "1"\n}\n'
    assert export.write_json({"b": [2]}, spark, path) and export.read_json(spark, path) == {"b": [2]} and export.read_json(spark, str(tmp_path / "none")) is None


def test_lenient_reader(spark, tmp_path):
    (tmp_path / "bad").write_text("{broken")
    assert archive.load_operations(spark, str(tmp_path / "bad"), lenient=True).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        archive.load_operations(spark, str(tmp_path / "bad")).count()


def test_decode(spark):
    rows = [("é".encode(), None, "é"), ("é".encode("latin-1"), "text/html", "é"), ("é".encode("latin-1"), "text/html; charset=ISO-8859-1", "é"), (b"a\xff", 'text/html; Charset="utf-8"', "a�"), ("é".encode(), "x; charset=klingon", "é")]
    got = spark.createDataFrame(rows, "content binary, kind string, want string").select(archive.decode(F.col("content"), F.col("kind")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got
