"""Flat and geographic exports. Files are written in parts whose concatenation in name order is the document."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marshlight.functions import constants as K
from marshlight.functions import geo
from marshlight.functions import text as X
from marshlight.session import stored
from marshlight.sources import archive, versions

BOM = "﻿"


def plain_number(x: Column, places: int) -> Column:
    """A rounded double without an exponent and with one digit behind the point at least."""
    digits = F.round(x, places).cast(f"decimal(24,{places})").cast("string")
    return F.regexp_replace(digits, r"(\.\d+?)0+$", "$1")


def _shape_side(shapes: DataFrame, *more: Column) -> DataFrame:
    """What an export needs of a shape, made once a shape and not once an operation."""
    return shapes.select("mid", "zone_code", "area_sq_km", geo.centroid(F.col("polygons")).alias("centre"), *more)


def _export_columns() -> list[Column]:
    given = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    number = lambda x, places: F.coalesce(plain_number(x, places), F.lit(""))
    return [
        F.col("id"), F.col("date"), F.col("method"), F.col("target"), F.coalesce(F.array_join("products", "; "), F.lit("")).alias("products"), given("period"), given("time_start"), given("time_end"),
        F.col("status"), given("status_text"), given("area_name"), given("zone_code"), X.region(F.col("zone_code")).alias("region"), given("boundary_text"),
        number(F.col("area_sq_km"), 4).alias("area_sq_km"), number(F.col("centre.lat"), 6).alias("centroid_lat"), number(F.col("centre.lon"), 6).alias("centroid_lon"),
        given("map_url"), F.col("mid").alias("map_id"), F.coalesce("source", F.lit("")).alias("observed_via"), given("first_seen"),
    ]


def export_rows(ops: DataFrame, shapes: DataFrame) -> DataFrame:
    """The 20 export columns and id: operations with their shape (mid, zone_code, area_sq_km, polygons), if there is one.

    Nulls become empty texts; an operation without a zone is in region Unknown; products are joined by "; ". Shapes have
    one row a mid; Spark broadcasts them while they are under its limit and else shuffles both sides.
    """
    return ops.join(_shape_side(shapes), "mid", "left").select(*_export_columns())


def csv_line(columns: tuple[str, ...] = K.EXPORT_COLUMNS) -> Column:
    """A CSV record: a field is quoted if it holds a comma, a quote or a line end."""

    def field(c: str) -> Column:
        value = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(value.rlike("[,\"\r\n]"), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)

    return F.concat_ws(",", *map(field, columns))


def write_csv(rows: DataFrame, path: str) -> None:
    """UTF-8 with a byte-order mark, CRLF line ends, header first, ordered by (date, area_name, id)."""
    spark = rows.sparkSession
    lines = rows.select("date", "area_name", "id", csv_line().alias("value"), F.lit(1).alias("_part"))
    head = spark.createDataFrame([(BOM + ",".join(K.EXPORT_COLUMNS),)], "value string").select(*(F.lit(None).cast("string").alias(c) for c in ("date", "area_name", "id")), "value", F.lit(0).alias("_part"))
    head.unionByName(lines).orderBy("_part", "date", "area_name", "id").select("value").write.option("lineSep", "\r\n").text(path)


def geometry_json() -> Column:
    """The polygons of a shape as a GeoJSON geometry."""
    return F.concat(F.lit('{"type":"'), geo.geometry_type(F.col("polygons")), F.lit('","coordinates":'), geo.geojson_coordinates(F.col("polygons")), F.lit("}"))


def feature_json() -> Column:
    """A GeoJSON feature of an export row with ``geometry``."""
    properties = F.to_json(F.struct(*K.EXPORT_COLUMNS, F.col("id").alias("operation_id")))
    return F.concat(F.lit('{"type":"Feature","id":'), _json_text(F.col("id")), F.lit(',"properties":'), properties, F.lit(',"geometry":'), F.col("geometry"), F.lit("}"))


def geojson_features(ops: DataFrame, shapes: DataFrame) -> DataFrame:
    """(id, date, area_name, feature): one GeoJSON feature for each operation whose shape has a geometry; the polygon is repeated."""
    drawn = _shape_side(shapes.filter(F.size("polygons") > 0), geometry_json().alias("geometry"))
    rows = ops.join(drawn, "mid").select(*_export_columns(), "geometry")
    return rows.select("id", "date", "area_name", feature_json().alias("feature"))


def _json_text(text: Column) -> Column:
    """A JSON string."""
    listed = F.to_json(F.array(text))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def write_document(elements: DataFrame, order: list[str], head: str, foot: str, path: str) -> None:
    """Write JSON texts (``value``) as the elements of one document, ordered by ``order``: parts, one element a line, whose
    concatenation in name order is the document. All elements but the last end in a comma, also where rows repeat."""
    rows = stored(elements.select("value", *order, F.monotonically_increasing_id().alias("_row")), "elements")
    end = rows.agg(F.max(F.struct(*order, "_row"))["_row"].alias("end")).first()["end"]
    body = rows.withColumns({"value": F.concat("value", F.when(F.col("_row") == F.lit(end).cast("long"), "").otherwise(",")), "_part": F.lit(1)})
    ends = [rows.sparkSession.createDataFrame([(text, part)], "value string, _part int") for text, part in ((head, 0), (foot, 2))]
    every = body.unionByName(ends[0], allowMissingColumns=True).unionByName(ends[1], allowMissingColumns=True)
    every.orderBy("_part", *order, "_row").select("value").write.text(path)


def geojson_extent(ops: DataFrame, shapes: DataFrame) -> DataFrame:
    """One row: bounds over all rings of the shapes in use, and how many operations have none and are skipped."""
    used = ops.join(shapes.filter(F.size("polygons") > 0).select("mid", geo.bbox(F.col("polygons")).alias("b")), "mid", "left")
    return used.agg(F.min("b.min_lon").alias("min_lon"), F.min("b.min_lat").alias("min_lat"), F.max("b.max_lon").alias("max_lon"), F.max("b.max_lat").alias("max_lat"), F.count_if(F.col("b").isNull()).alias("skipped"))


def write_geojson(ops: DataFrame, shapes: DataFrame, path: str) -> int:
    """A feature collection, ordered as the CSV; the bounds are left out if there is no feature. Returns the operations skipped."""
    extent = geojson_extent(ops, shapes).first()
    bounds = [extent[k] for k in ("min_lon", "min_lat", "max_lon", "max_lat")]
    first = '{"type":"FeatureCollection",' + (f'"bbox":{bounds},' if bounds[0] is not None else "") + '"features":['
    features = geojson_features(ops, shapes).withColumnRenamed("feature", "value")
    write_document(features, ["date", "area_name", "id"], first, "]}", path)
    return extent["skipped"]


def fingerprint(rows: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """One row that names a table's content whatever its order, without the columns ``but`` (a clock)."""
    texts = {f.name: F.to_json(f.name) for f in rows.schema if f.dataType.typeName() == "variant"}  # variants have no hash of their own
    rows, columns = rows.withColumns(texts), sorted(c for c in rows.columns if c not in but)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("h1"), F.sum(F.xxhash64(F.lit(7), *columns).cast("decimal(38,0)")).alias("h2"))


def write_if_changed(rows: DataFrame, path: str, clock: tuple[str, ...] = ()) -> bool:
    """Replace the Parquet table published at ``path`` unless it holds the same rows but for the clock columns; True if it
    was written. Read it with ``versions.current_table``; a reader never sees a part of it, nor no table."""
    spark = rows.sparkSession
    if versions.newest_version(spark, path):
        old = versions.current_table(spark, path)
        if sorted(old.columns) == sorted(rows.columns) and fingerprint(old, clock).first() == fingerprint(rows, clock).first():
            return False
    versions.replace_folder(spark, path, lambda folder: rows.write.parquet(folder))
    return True


def operation_json(ops: DataFrame) -> Column:
    """An operation as JSON: keys in alphabetical order, nulls kept, keys outside the contract (``more``) among them; a key that
    ``present`` doesn't list is left out."""
    names = sorted(c for c in ops.columns if c in archive.OPERATION_FIELDS)
    plain = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    if not {"more", "present"} & set(ops.columns):
        return plain
    listed = F.col("present") if "present" in ops.columns else F.lit(None).cast("array<string>")
    more = F.col("more") if "more" in ops.columns else F.lit(None).cast("variant")
    known = F.create_map(*(x for c in names for x in (F.lit(c), F.col(c).cast("variant"))))
    left = F.map_filter(known, lambda k, _: ~k.isin(*K.MUTABLE) | listed.isNull() | F.array_contains(listed, k))
    every = F.map_concat(left, F.coalesce(more.cast("map<string,variant>"), F.create_map().cast("map<string,variant>")))
    keys = F.sort_array(F.map_keys(every))
    full = F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(every, k))), {"ignoreNullFields": "false"})
    held = [c for c in K.MUTABLE if c in names]
    usual = more.isNull() & (listed.isNull() | (F.size(F.array_intersect(listed, F.array(*map(F.lit, held)))) == len(held)) if held else more.isNull())
    return F.when(usual, plain).otherwise(full)


def write_operations(ops: DataFrame, path: str, generated_at: str, base: int | None = None) -> bool:
    """Publish the operations document at ``path``, ordered by (date, id), unless only the clock would differ; True if it was written.
    ``base``: the version that ``ops`` were made from (see ``versions.replace_folder``)."""
    keys = [F.coalesce(c, F.lit("")).alias(f"_{c}") for c in ("date", "id")]
    own = ops.select(*(c for c in ops.columns if c in archive.OPERATION_FIELDS or c in ("more", "present")))
    if _same(ops.sparkSession, path, archive.load_operations, own):
        return False
    elements = own.select(operation_json(own).alias("value"), *keys)
    head = '{"generated_at":' + json.dumps(generated_at) + ',"operations":['
    versions.replace_folder(ops.sparkSession, path, lambda folder: write_document(elements, ["_date", "_id"], head, "]}", folder), base)
    return True


def write_shapes(shapes: DataFrame, path: str, base: int | None = None) -> bool:
    """Publish the shapes as a feature collection ordered by mid, unless it holds them already; True if it was written. ``base`` as for operations."""
    if _same(shapes.sparkSession, path, archive.load_shapes, shapes):
        return False
    names = sorted(c for c in ("mid", "zone_code", "doc_name", "doc_description", "fetched_at", "area_sq_km") if c in shapes.columns)
    geometry = F.concat(F.lit('{"type":"'), F.col("geom_type"), F.lit('","coordinates":'), geo.geojson_coordinates(F.col("polygons")), F.lit("}"))
    parts = [F.lit('{"type":"Feature","id":'), _json_text(F.col("mid")), F.lit(',"properties":'), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}")]
    elements = shapes.select(F.concat(*parts).alias("value"), "mid")
    versions.replace_folder(shapes.sparkSession, path, lambda folder: write_document(elements, ["mid"], '{"type":"FeatureCollection","features":[', "]}", folder), base)
    return True


def _same(spark: SparkSession, path: str, load: Callable[[SparkSession, str], DataFrame], rows: DataFrame) -> bool:
    """Whether the document published at ``path`` has just these rows, as far as it can be read."""
    if not versions.newest_version(spark, path):
        return False
    try:
        old = load(spark, path)
        shared = [c for c in old.columns if c in rows.columns]
        old, own = (t.select(*shared, *(F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns if c not in shared)) for t in (old, rows))
        if "present" in old.columns:
            every = F.array(*(F.lit(c) for c in sorted(K.MUTABLE) if c in rows.columns))
            old, own = (t.withColumn("present", F.sort_array(F.coalesce("present", every))) for t in (old, own))
        return fingerprint(old).first() == fingerprint(own).first()
    except Exception:  # noqa: BLE001 - a document that can't be read is written anew
        return False


def write_json(document: dict, spark: SparkSession, path: str, clock: str | None = "generated_at") -> bool:
    """Publish a small document (a manifest) as JSON with sorted keys, two blanks a level and UTF-8 as it is, unless it is
    there already but for the clock; True if it was written."""
    text = json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False)
    found = read_json(spark, path)
    plain = lambda d: {k: v for k, v in d.items() if k != clock}
    if found is not None and plain(found) == plain(json.loads(text)):
        return False
    lines = spark.createDataFrame([(text,)], "value string").coalesce(1)
    versions.replace_folder(spark, path, lambda folder: lines.write.text(folder))
    return True


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small document that ``write_json`` published; None without one, or if it can't be read."""
    folder = versions.current_folder(spark, path)
    if folder is None:
        return None
    try:
        return json.loads(spark.read.text(folder, wholetext=True).first()["value"])
    except (ValueError, TypeError):
        return None


def seed_missing(spark: SparkSession, source: str, target: str, names: tuple[str, ...]) -> int:
    """Copy the published tables that the target lacks; existing ones are never touched. Returns how many were copied."""
    lacking = [n for n in names if not versions.newest_version(spark, f"{target}/{n}")]
    for n in lacking:
        rows = versions.current_table(spark, f"{source}/{n}")
        versions.replace_folder(spark, f"{target}/{n}", lambda folder, rows=rows: rows.write.parquet(folder))
    return len(lacking)
