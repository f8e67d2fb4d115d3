"""The source of cached captures and the sink of the exports."""

from __future__ import annotations

import csv
import io
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marshlight.functions import constants as K
from marshlight.operators import sink
from marshlight.plans import pipeline
from marshlight.sources import captures, folders, versions

from test_merge import clean_archive, shapes

BODY = "x" * K.SMALLEST_PAGE


def cache(tmp_path, bodies):
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body if isinstance(body, bytes) else body.encode())


def test_captures_are_read(spark, tmp_path):
    cache(tmp_path, {"20200101000000.html": BODY, "20210101000000.html": "é" * K.SMALLEST_PAGE, "20220101000000.html": b"\xff" + BODY.encode(), "20230101000000.html": "short", "x.html": BODY, "20240101000000.txt": BODY})
    (tmp_path / "20250101000000.html").mkdir()
    rows = captures.cached_captures(spark, str(tmp_path)).collect()
    assert {r.stamp: (r.source, len(r.html)) for r in rows} == {
        "20200101000000": ("wayback:20200101000000", K.SMALLEST_PAGE), "20210101000000": ("wayback:20210101000000", K.SMALLEST_PAGE), "20220101000000": ("wayback:20220101000000", K.SMALLEST_PAGE + 1),
    }
    assert captures.cached_captures(spark, str(tmp_path), smallest="1").count() == 4
    empty = tmp_path / "none"
    empty.mkdir()
    assert captures.cached_captures(spark, str(empty)).count() == 0


def test_stamp_filters_choose_files(spark, tmp_path):
    """A file that no filter wants isn't opened: it can't even be read here."""
    cache(tmp_path, {f"20{y}0101000000.html": BODY for y in range(10, 30)})
    for y in range(10, 20):
        path = tmp_path / f"20{y}0101000000.html"
        path.unlink()
        path.symlink_to(tmp_path / "nowhere")
    table = captures.cached_captures(spark, str(tmp_path))
    assert table.filter("stamp >= '20200101000000'").count() == 10
    assert sorted(r.stamp for r in table.filter("stamp > '20220101000000' and stamp < '20250101000000' and length(html) > 5").collect()) == ["20230101000000", "20240101000000"]
    assert table.filter("stamp in ('20210101000000', '20280101000000')").count() == 2
    assert table.filter("stamp = '20290101000000' and source like 'way%'").count() == 1
    reader = captures.CaptureReader({"path": str(tmp_path), "partitionBytes": str(3 * len(BODY))})
    from pyspark.sql.datasource import GreaterThanOrEqual, IsNotNull

    left = list(reader.pushFilters([IsNotNull(("stamp",)), GreaterThanOrEqual(("stamp",), "20200101000000")]))
    assert left == [IsNotNull(("stamp",))] and [len(p.paths) for p in reader.partitions()] == [3, 3, 3, 1]


def test_captures_are_cached(spark, tmp_path):
    pages = spark.createDataFrame([("20200101000000", BODY), ("20200101000000", BODY), ("20200102000000", None), ("bad", BODY)], "stamp string, html string")
    assert captures.cache_captures(pages, str(tmp_path / "c")) == 2
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["20200101000000.html", "20200102000000.html"]


def operations(spark, n=40):
    rows = clean_archive(spark).withColumns({c: F.lit(None).cast("string") for c in ("period", "time_start", "time_end", "boundary_text", "status_text")}).withColumn("products_raw", F.col("products"))
    many = rows.crossJoin(spark.range(n).withColumnRenamed("id", "n")).withColumn("id", F.concat_ws("#", "id", "n")).withColumn("area_name", F.concat(F.lit('say "'), F.col("n"), F.lit('", é'))).drop("n")
    return many.withColumn("mid", F.when(F.col("mid") == "m5", "none").otherwise(F.col("mid")))


def documents(path):
    about = json.loads(max((Path(path) / "_versions").glob("v*.json"), key=lambda p: int(p.stem[1:])).read_text())
    read = lambda name: b"".join(p.read_bytes() for p in sorted((Path(path) / about["folder"] / name).iterdir()))
    return about, read("operations.csv"), json.loads(read("operations.geojson"))


def test_export_is_published(spark, tmp_path):
    path = str(tmp_path / "exports")
    ops = operations(spark)
    table = shapes(spark).withColumns({"zone_code": F.lit(None).cast("string"), "area_sq_km": F.lit(1.5)}).drop("id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts
    try:
        assert pipeline.run_export(ops.repartition(5), table, path) == 40
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    about, flat, shaped = documents(path)
    assert (about["rows"], about["features"], about["skipped"]) == (200, 160, 40) and shaped["bbox"] == about["bbox"] == [-121.0, 37.5, -120.9, 37.6]
    assert len(list((Path(path) / about["folder"] / "operations.csv").iterdir())) > 2
    assert flat.startswith(b"\xef\xbb\xbf") and flat.count(b"\r\n") == 201
    rows = list(csv.DictReader(io.StringIO(flat.decode("utf-8-sig"), newline="")))
    keys = [(r["date"], r["area_name"]) for r in rows]
    assert len(rows) == 200 and keys == sorted(keys) and rows[0]["area_name"].startswith('say "')
    ids = [f["id"] for f in shaped["features"]]
    assert len(set(ids)) == 160 and all(f["properties"]["operation_id"] == f["id"] and len(f["geometry"]["coordinates"][0]) == 4 for f in shaped["features"])
    assert [(f["properties"]["date"], f["properties"]["area_name"]) for f in shaped["features"]] == sorted((f["properties"]["date"], f["properties"]["area_name"]) for f in shaped["features"])
    assert sorted(json.loads(r.feature)["id"] for r in sink.exported_features(spark, path).collect()) == sorted(ids)
    assert pipeline.run_export(ops.filter("1 = 0"), table, path) == 0  # a second export, of nothing
    about, flat, shaped = documents(path)
    assert flat.count(b"\r\n") == 1 and shaped == {"type": "FeatureCollection", "features": []} and versions.newest_version(spark, path) == 2


def test_failed_export_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "exports")
    table = shapes(spark).withColumns({"zone_code": F.lit(None).cast("string"), "area_sq_km": F.lit(1.5)}).drop("id")
    sink.publish_export(operations(spark, 2), table, path)
    before = documents(path)
    broken = operations(spark, 2).withColumn("map_url", F.when(F.col("mid") == "m3", F.raise_error(F.lit("no url")).cast("string")).otherwise(F.col("map_url")))
    with pytest.raises(Exception, match="no url"):
        sink.publish_export(broken, table, path)
    assert documents(path) == before and versions.newest_version(spark, path) == 1
    assert [p.name for p in Path(path).iterdir() if p.name.startswith("data-")] == [before[0]["folder"]]  # nothing is left of the failed one


def test_export_version_is_taken_once(tmp_path):
    system, path = folders.open_folder(f"file:{tmp_path}/e")
    assert folders.publish(system, path, 1, {"a": 1}) and not folders.publish(system, path, 1, {"a": 2})
    assert folders.newest(system, path) == 1 and json.loads((tmp_path / "e" / "_versions" / "v1.json").read_text()) == {"a": 1}
    assert len(list((tmp_path / "e" / "_versions").iterdir())) == 1
