"""KML documents to shapes: a table function reads the XML, geometry is built from Column functions."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from marshlight.functions import geo
from marshlight.functions import text as X


def _text(node: ET.Element | None) -> str | None:
    return node.text if node is not None else None


_RAW = "array<struct<outer:string,inners:array<string>>>"
_RAW_ARROW = pa.list_(pa.struct([("outer", pa.string()), ("inners", pa.list_(pa.string()))]))


def read_kml(xml: str | None) -> tuple[bool, str | None, str | None, list[dict]]:
    """A document's own name and description (a Document's, if there is one), and the coordinate texts of all polygons; the first is false if it isn't XML."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return False, None, None, []
    own = root.find(".//{*}Document")
    own = own if own is not None or root.tag.rpartition("}")[2] != "Document" else root
    prefix = "{*}" if own is not None else ".//{*}"
    own = root if own is None else own
    ring = "{*}LinearRing/{*}coordinates"
    polygons = [{"outer": _text(p.find("{*}outerBoundaryIs/" + ring)), "inners": [_text(i) for i in p.findall("{*}innerBoundaryIs/" + ring)]} for p in root.iter() if p.tag.rpartition("}")[2] == "Polygon"]
    return True, _text(own.find(f"{prefix}name")), _text(own.find(f"{prefix}description")), polygons


@arrow_udtf(returnType=f"mid string, ok boolean, doc_name string, doc_description string, raw {_RAW}")
class ReadKml:
    """``marshlight_read_kml(TABLE(mid, xml))``: one row a document, a batch of documents at a time."""

    def eval(self, documents: pa.RecordBatch) -> Iterator[pa.Table]:
        read = [read_kml(xml) for xml in documents.column(1).to_pylist()]
        columns = [pa.array([r[k] for r in read], kind) for k, kind in enumerate((pa.bool_(), pa.string(), pa.string(), _RAW_ARROW))]
        yield pa.table([documents.column(0), *columns], names=["mid", "ok", "doc_name", "doc_description", "raw"])


def shapes_of_kml(documents: DataFrame, fetched_at: Column) -> DataFrame:
    """(mid, xml) to shapes, each with ``reason``: null, no_polygon (or not XML) or out_of_bounds."""
    spark = documents.sparkSession
    spark.udtf.register("marshlight_read_kml", ReadKml)
    plain = documents.select(F.col("mid").cast("string").alias("mid"), F.col("xml").cast("string").alias("xml"))
    read = spark.sql("SELECT * FROM marshlight_read_kml(TABLE(SELECT mid, xml FROM {d}))", d=plain)
    built = read.withColumn("polygons", geo.build_polygons(F.col("raw")))
    reason = F.when(F.size("polygons") == 0, "no_polygon").when(geo.out_of_bounds(F.col("polygons")), "out_of_bounds")
    name = lambda c: X.none_if_empty(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return built.select(
        "mid", X.zone_code(name(F.col("doc_name"))).alias("zone_code"), name(F.col("doc_name")).alias("doc_name"), name(F.col("doc_description")).alias("doc_description"),
        fetched_at.alias("fetched_at"), geo.area_sq_km(F.col("polygons")).alias("area_sq_km"), geo.geometry_type(F.col("polygons")).alias("geom_type"), "polygons", reason.alias("reason"),
    )


def rederive_zones(shapes: DataFrame) -> DataFrame:
    """Zone codes from the stored names anew; a name without one keeps the stored code."""
    return shapes.withColumn("zone_code", F.coalesce(X.zone_code(F.col("doc_name")), "zone_code"))
